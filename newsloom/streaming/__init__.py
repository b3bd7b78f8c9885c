"""Structured Streaming versions of the jobs that carry state."""
