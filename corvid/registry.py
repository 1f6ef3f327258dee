"""Named queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from corvid.plans import answer_queries, eval_queries, ingest_queries, search_queries, table_queries

QUERIES: dict = search_queries.QUERIES | ingest_queries.QUERIES | eval_queries.QUERIES | answer_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL: dict[str, str] = search_queries.ORACLE_SQL | ingest_queries.ORACLE_SQL | eval_queries.ORACLE_SQL | answer_queries.ORACLE_SQL | table_queries.ORACLE_SQL
