"""Registered queries over the driver's tables."""

from __future__ import annotations

from engram.plans import queries_graph, queries_merge, queries_modes, queries_retrieval, queries_scan, queries_upkeep  # noqa: F401  they register themselves
from engram.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
