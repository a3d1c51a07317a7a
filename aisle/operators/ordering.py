"""Ranks and running sums over whole tables, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions.exprs import beside
from aisle.session import checkpointed


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], partition: Sequence[str] = (), number: str = "row_no"
) -> DataFrame:
    """Row number and running sums along ``order`` inside ``partition``.

    Rows are range-partitioned into slices by (partition, order), so one hot
    partition spans many tasks. Each slice is numbered on its own and shifted
    by the totals of the slices before it; there are only as many totals as
    slices. ``order`` must be a total order. The slices are checkpointed since
    a recomputed range partitioning could cut at other points. Null keys of
    ``partition`` are a partition; null values add nothing to a sum.

    ``sums`` maps a new column to the column it accumulates.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in partition]
    cut = checkpointed(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    before = Window.partitionBy(*partition).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*partition, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = cut.groupBy(*partition, "_slice").agg(
        F.count("*").alias("_rows"), *[F.sum(source).alias(f"_{name}") for name, source in sums.items()]
    )
    shifts = totals.select(
        *partition, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums],
    )
    numbered = cut.withColumn("_no", F.row_number().over(inside).cast("bigint"))
    for name, source in sums.items():
        numbered = numbered.withColumn(f"_run_{name}", F.coalesce(F.sum(source).over(inside), F.lit(0)))
    joined = _join_keys(numbered, shifts, [*partition, "_slice"])
    return joined.select(
        *df.columns, (F.col("_no") + F.col("_rows")).alias(number),
        *[(F.col(f"_run_{name}") + F.col(f"_{name}")).alias(name) for name in sums],
    )


def _join_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null."""
    named = other.withColumnsRenamed({c: f"_other_{c}" for c in keys})
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    return df.join(named, same).drop(*[f"_other_{c}" for c in keys])


def counts_by_value(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with row counts (and weight sums); repeated values collapse before the shuffle."""
    extra = [F.sum(weight).alias("_weight")] if weight else []
    return df.groupBy(*keys, value).agg(F.count("*").alias("_n"), *extra)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles per key, for groups of any size.

    Distinct values are numbered by their running count; the values at the two
    neighbouring positions of each percentile are then picked by an aggregate.
    Null values do not count; a key without other values has null percentiles.
    A null key is a key.
    """
    counted = checkpointed(counts_by_value(df, keys, value)).withColumn(
        "_n", F.when(F.col(value).isNull(), 0).otherwise(F.col("_n")))
    ranked = running_totals(counted, [F.col(value).asc_nulls_last()], {"_upto": "_n"}, keys)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    placed = _join_keys(ranked, sizes, keys) if keys else beside(ranked, sizes)
    aggregates = []
    for name, p in points.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.floor(at) + 1, F.ceil(at) + 1
        start = F.col("_upto") - F.col("_n")
        holds = lambda position: (start < position) & (F.col("_upto") >= position)
        part = at - F.floor(at)
        lower = F.max(F.when(holds(low), F.col(value)))
        upper = F.max(F.when(holds(high), F.col(value)))
        aggregates.append((lower + (upper - lower) * F.max(part)).alias(name))
    return placed.groupBy(*keys).agg(*aggregates)


def percent_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "percent_rank") -> DataFrame:
    """``percent_rank`` of the value, highest first, inside each key; null values come last, a null key is a key."""
    counted = checkpointed(counts_by_value(df, keys, value))
    ranked = running_totals(counted, [F.col(value).desc_nulls_last()], {"_upto": "_n"}, keys)
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    placed = _join_keys(ranked, sizes, keys) if keys else beside(ranked, sizes)
    rank = F.col("_upto") - F.col("_n")
    ranks = placed.select(
        *keys, value, F.when(F.col("_size") > 1, rank / (F.col("_size") - 1)).otherwise(0.0).alias(name)
    )
    return _join_keys(df, ranks, [*keys, value])


def abc_classes(df: DataFrame, key: str, value: str, edges: tuple[float, float] = (0.8, 0.95)) -> DataFrame:
    """Pareto class by cumulative share of the value, largest first, ties by key."""
    rows = checkpointed(df.select(key, value))
    ranked = running_totals(rows, [F.col(value).desc(), F.col(key)], {"_upto": value})
    total = rows.agg(F.sum(value).alias("_total"))
    share = F.col("_upto") / F.col("_total")
    label = F.when(share <= edges[0], "A").when(share <= edges[1], "B").otherwise("C")
    return beside(ranked, total).select(
        key, value, share.alias("cumulative_share"), label.alias("abc_class")
    )


def equal_frequency_bins(df: DataFrame, order: Sequence[Column], bins: int, name: str = "bin") -> DataFrame:
    """Bins of equal size along a total order, the first bins taking the remainder."""
    rows = checkpointed(df)
    numbered = running_totals(rows, order, {})
    size = rows.agg(F.count("*").alias("_size"))
    small = F.floor(F.col("_size") / bins)
    rest = F.col("_size") % bins
    edge = rest * (small + 1)
    at = F.col("row_no") - 1
    bucket = F.when(at < edge, F.floor(at / (small + 1))).otherwise(
        rest + F.floor(F.try_divide(at - edge, small)))
    return beside(numbered, size).select(*df.columns, (bucket + 1).cast("int").alias(name))
