"""Registry of queries: a Spark callable and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aisle.plans.sqlviews import VIEWS
from aisle.sources.retail import Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def expand(sql: str) -> str:
    """Put the views a statement uses in front of it as common table expressions."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in used and re.search(rf"\b(?:from|join)\s+{name}\b", text, re.I):
                visit(body)
                if name not in used:
                    used.append(name)

    visit(sql)
    sql = sql.strip()
    if not used:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in used)
    start = re.match(r"with(\s+recursive)?\s+", sql, re.I)
    if start:
        keyword = "WITH RECURSIVE" if start.group(1) else "WITH"
        return f"{keyword} {views},\n{sql[start.end():]}"
    return f"WITH {views}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register a function of the tables under an operator name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} exists")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = expand(sql)
        return fn

    return register


def _bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Tables(spark, folder))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    return dict(_SQL)
