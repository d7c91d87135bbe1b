"""Queries of the reference operators, by name, and the SQL that gives the same results."""

from __future__ import annotations

from sandhi.plans import ingest_queries, io_queries, score_queries, select_queries, text_queries  # noqa: F401
from sandhi.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
