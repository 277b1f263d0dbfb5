"""All named queries of the corpus engine and their SQL."""

from __future__ import annotations

from lodestone.plans import ingest, jobs, markup, relational, search

_PARTS = [search, relational, markup, ingest, jobs]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
