"""The registered queries, by module; each module has QUERIES and, where SQL can say the same, SQL."""

from __future__ import annotations

import importlib

MODULES = ["data_problems", "search"]


def collect() -> tuple[dict, dict]:
    """All queries and all SQL of the core modules."""
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"skeinlog.queries.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
