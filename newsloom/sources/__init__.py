"""Readers of landed payloads and writers of dated tables."""
