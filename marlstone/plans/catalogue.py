"""Every registered query and the DuckDB statement that must give the same rows."""

from __future__ import annotations

from . import corpus_queries, evaluation_queries, search_queries, state_queries, store_queries

_PARTS = (corpus_queries, search_queries, evaluation_queries, state_queries, store_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
