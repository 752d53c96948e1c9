"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("rollups", "ingest", "perception", "trends")


def _collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"eventide.queries.{name}")
        queries.update(m.QUERIES)
        sql.update(m.SQL)
    return queries, sql


def queries() -> dict:
    return _collect()[0]


def oracle_sql() -> dict[str, str]:
    return _collect()[1]
