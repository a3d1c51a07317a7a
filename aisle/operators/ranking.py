"""Top-k selection, per-row ordering and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.operators.joins import dedupe


def top_keys(df: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The n keys with the largest total, ties by key."""
    totals = df.groupBy(key).agg(F.sum(measure).alias("_total"))
    return totals.orderBy(F.desc("_total"), key).limit(n).select(key)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rank") -> DataFrame:
    """First n rows per key; every task keeps at most n per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)


def best_column(columns: Sequence[str]) -> Column:
    """Name of the largest column, the first listed among equals."""
    best = F.greatest(*columns)
    out = None
    for c in columns:
        out = F.when(F.col(c) == best, F.lit(c)) if out is None else out.when(F.col(c) == best, F.lit(c))
    return out


def ordered_columns(columns: Sequence[str]) -> Column:
    """Column names of one row from the largest to the smallest value, nulls last, ties in listed order."""
    cells = F.array(*[
        F.struct(
            F.col(c).isNull().alias("missing"), (-F.col(c)).alias("value"), F.lit(i).alias("at"), F.lit(c).alias("name")
        )
        for i, c in enumerate(columns)
    ])
    return F.transform(F.array_sort(cells), lambda cell: cell["name"])


def old_wins(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union where a stored row wins over a new one with the same key."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return dedupe(both, keys, ["_age", *order]).drop("_age")


def member_overlap(df: DataFrame, member: str, first: Column, second: Column) -> DataFrame:
    """Members of two conditions and of both, from one pass."""
    flags = df.where(first | second).groupBy(member).agg(
        F.max(first.cast("int")).alias("_a"), F.max(second.cast("int")).alias("_b")
    )
    return flags.agg(
        F.count_if(F.col("_a") == 1).alias("in_first"),
        F.count_if(F.col("_b") == 1).alias("in_second"),
        F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("in_both"),
    )
