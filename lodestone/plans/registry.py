"""Named queries over the standard tables, and their SQL for a second engine."""

from __future__ import annotations

from . import report_queries, search_queries, state_queries, store_queries

QUERIES = {**search_queries.QUERIES, **report_queries.Q, **store_queries.QUERIES, **state_queries.Q}
ORACLE_SQL = {**search_queries.ORACLE_SQL, **report_queries.SQL, **store_queries.ORACLE_SQL, **state_queries.SQL}
