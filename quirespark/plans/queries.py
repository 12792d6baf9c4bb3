"""All registered queries and their SQL."""

from __future__ import annotations

from . import catalog_queries, ingest_queries, lifecycle_queries, search_queries  # noqa: F401  registers them
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
