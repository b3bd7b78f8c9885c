"""Every operator as a query over the given tables, with its SQL twin."""

from newsloom.catalog.registry import SQL, QUERIES, load_all

__all__ = ["QUERIES", "SQL", "load_all"]
