"""Aggregations, pivots and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions.exprs import beside


def describe_by(df: DataFrame, keys: Sequence[str], counted: str, measure: str) -> DataFrame:
    """Distinct periods, first and last period, and total, mean, extremes of a measure per key."""
    return df.groupBy(*keys).agg(
        F.count_distinct(counted).alias("n_periods"), F.min(counted).alias("first_period"),
        F.max(counted).alias("last_period"), F.sum(measure).alias("total"), F.avg(measure).alias("mean"),
        F.max(measure).alias("highest"), F.min(measure).alias("lowest"),
    )


def presence_then_count(
    df: DataFrame, item: str, keys: Sequence[str], flags: dict[str, Column]
) -> DataFrame:
    """Flags per item first, then the number of items carrying each flag per key."""
    per_item = df.groupBy(*keys, item).agg(*[F.max(c.cast("int")).alias(n) for n, c in flags.items()])
    return per_item.groupBy(*keys).agg(*[F.sum(n).cast("bigint").alias(n) for n in flags])


def distinct_values(df: DataFrame, column: str, most: int = 200) -> list:
    """The values of a column in order, null last, to become columns of a wide table.

    A small aggregate of its own. More than ``most`` values are an error that
    says how many there are, so none is lost.
    """
    found = [r[0] for r in df.select(column).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{df.select(column).distinct().count()} values of {column}, more than {most}")
    return sorted([v for v in found if v is not None]) + [None] * (None in found)


def pivot_sum(
    df: DataFrame, keys: Sequence[str], column: str, measure: Column, prefix: str = "", values: Sequence | None = None
) -> DataFrame:
    """Sum of a measure with one column per value, missing cells 0. Without ``values`` those of the data are found first."""
    values = distinct_values(df, column) if values is None else values
    name = lambda v: "null" if v is None else str(v).lower().replace(" ", "_").replace("-", "_")
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col(column).eqNullSafe(F.lit(v)), measure)), F.lit(0)).alias(f"{prefix}{name(v)}") for v in values])


def onehot_counts(
    df: DataFrame, keys: Sequence[str], column: str, item: str, prefix: str, values: Sequence | None = None
) -> DataFrame:
    """Distinct items per value, one numbered column per value in order. Without ``values`` those of the data are found first."""
    values = distinct_values(df, column) if values is None else values
    return df.groupBy(*keys).agg(*[
        F.count_distinct(F.when(F.col(column).eqNullSafe(F.lit(v)), F.col(item))).alias(f"{prefix}{i}")
        for i, v in enumerate(values, 1)
    ])


def number_stats(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Minimum, maximum and mean of a measure per key, 0 where there is none."""
    stats = df.groupBy(*keys).agg(
        F.min(measure).alias(f"{measure}_min"), F.max(measure).alias(f"{measure}_max"),
        F.avg(measure).alias(f"{measure}_mean"),
    )
    return stats.na.fill(0.0)


def contribution(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Share of each key in the grand total of every measure.

    Totals are summed from the grouped rows.
    """
    grouped = df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    total = grouped.agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    return beside(grouped, total).select(
        *keys, *measures, *[F.try_divide(F.col(m), F.col(f"_{m}")).alias(f"{m}_share") for m in measures]
    )


def period_distribution(df: DataFrame, period: str, bin_: str) -> DataFrame:
    """Share of each bin inside its period."""
    counted = df.groupBy(period, bin_).agg(F.count("*").alias("rows"))
    whole = F.sum("rows").over(Window.partitionBy(period))
    return counted.withColumn("share", F.col("rows") / whole)


def add_total(df: DataFrame, keys: Sequence[str], column: str, label: str, measures: Sequence[str]) -> DataFrame:
    """Rows per key followed by their total under ``label`` in ``column``."""
    base = df.groupBy(*keys, column).agg(*[F.sum(m).alias(m) for m in measures])
    total = base.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]).withColumn(column, F.lit(label))
    return base.unionByName(total)


def robust_mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per key; among tied values 1 is dropped and the lower median taken.

    A key whose only most frequent value is 1 keeps 1.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    # The candidates of one key are collected only at its highest count.
    top = counted.groupBy(*keys).agg(F.max("_n").alias("_n"))
    tied = counted.join(top, [*keys, "_n"])
    others = F.col(value) != 1
    ranked = tied.withColumn(
        "_at", F.row_number().over(Window.partitionBy(*keys, others).orderBy(value))
    ).withColumn("_size", F.count("*").over(Window.partitionBy(*keys, others)))
    middle = others & (F.col("_at") == F.floor((F.col("_size") - 1) / 2) + 1)
    return ranked.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(middle, F.col(value))), F.lit(1).cast(df.schema[value].dataType)).alias(name)
    )


def weekday_pivot(df: DataFrame, keys: Sequence[str], date: str, week: str, measure: str) -> DataFrame:
    """Measure per weekday and week with week total and two half-week totals.

    The first half holds Monday, Tuesday and the Saturday and Sunday of the
    week row before; the second half Wednesday to Friday.
    """
    names = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    day = F.weekday(F.col(date))
    wide = df.groupBy(*keys, week).agg(*[
        F.sum(F.when(day == i, F.col(measure)).otherwise(0.0)).alias(n) for i, n in enumerate(names)
    ])
    before = Window.partitionBy(*keys).orderBy(week)
    lagged = {f"_{n}": F.coalesce(F.lag(n).over(before), F.lit(0.0)) for n in ("sat", "sun")}
    total = sum((F.col(n) for n in names[1:]), F.col("mon"))
    return wide.withColumns(lagged).select(
        *keys, week, *names, total.alias("week_total"),
        (F.col("mon") + F.col("tue") + F.col("_sat") + F.col("_sun")).alias("first_half"),
        (F.col("wed") + F.col("thu") + F.col("fri")).alias("second_half"),
    )


def correlations(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each column with the target, one row per column."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "corr")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns, from one aggregate."""
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"))
        for i, a in enumerate(columns) for b in columns[i:]
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
