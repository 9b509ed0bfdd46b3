"""Registered queries: name to (run, checking SQL or None)."""

from . import catalog, layouts, records, shelves, strings

QUERIES = catalog.QUERIES | records.QUERIES | shelves.QUERIES | strings.QUERIES | layouts.QUERIES
