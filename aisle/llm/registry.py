"""Queries of the operators for training data, and SQL where DuckDB can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    importlib.import_module("aisle.llm.queries")
    pipeline = importlib.import_module("corpus_pipeline")
    _QUERIES["pipeline"] = pipeline.run
    if pipeline.ORACLE_SQL is not None:
        _SQL["pipeline"] = pipeline.ORACLE_SQL


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def llm_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
