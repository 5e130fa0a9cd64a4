"""One query for each operator, and its SQL."""

from __future__ import annotations

from runforge.plans import job_queries, run_queries, text_queries  # noqa: F401  each adds its queries

QUERIES = run_queries.QUERIES
ORACLE_SQL = run_queries.ORACLE_SQL
