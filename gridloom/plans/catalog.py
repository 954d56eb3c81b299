"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from gridloom.plans import queries_collections, queries_files, queries_models, queries_reductions, queries_sources  # noqa: F401
from gridloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
