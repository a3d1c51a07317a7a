"""Registered queries. Importing the package fills the registry."""

from aisle.plans import (  # noqa: F401
    aggregates,
    cleaning,
    dates,
    evaluation,
    windows,
    joins,
    kpi,
    learning,
    promotion,
    quality,
    storage,
    text,
    timeseries,
)
from aisle.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
