"""Registered queries and their DuckDB equivalents."""

from shelfmark.queries import catalog, learning, stores, timeline

QUERIES = catalog.QUERIES | timeline.QUERIES | learning.QUERIES | stores.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | timeline.ORACLE_SQL | learning.ORACLE_SQL | stores.ORACLE_SQL
