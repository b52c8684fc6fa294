"""Queries by key, each with the SQL that gives the same rows in DuckDB (or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubespark.sources.adapters import CTES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. The SQL may name any of CTES; those it needs are put before it."""

    def add(f: Query) -> Query:
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = with_views(sql)
        return f

    return add


def with_views(sql: str) -> str:
    """The SQL with the views that it needs, each after those that it needs itself."""
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in CTES:
            if name != own and name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                order.append(name)

    visit(sql)
    views = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    if not views:
        return sql
    return f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}"
