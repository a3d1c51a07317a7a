"""Window steps that need more than one column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions import windows as win


@dataclass(frozen=True)
class FeatureSpec:
    """One block of window features: a column over a key set, periods and statistics."""

    column: str
    keys: tuple[str, ...]
    horizons: tuple[int, ...]
    stats: tuple[str, ...]
    lag: int = 1


def feature_grid(df: DataFrame, order: str, specs: Sequence[FeatureSpec]) -> DataFrame:
    """All blocks of features in one select; ``order`` is a running period number."""
    columns = []
    for spec in specs:
        window = win.series(spec.keys, order)
        for horizon in spec.horizons:
            frame = window.rangeBetween(-(spec.lag + horizon - 1), -spec.lag)
            columns += [
                win.STATS[s](spec.column).over(frame).alias(f"{'_'.join(spec.keys)}_{spec.column}_{horizon}_{s}")
                for s in spec.stats
            ]
    return df.select("*", *columns)


def lag_rolling_rows(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, pairs: Sequence[tuple[int, int]],
    stats: Sequence[str] = ("mean", "median", "max", "min"),
) -> DataFrame:
    """Statistics over the last rows of a lagged measure."""
    spec = win.series(keys, order)
    steps = sorted({lag for lag, _ in pairs})
    lagged = df.select("*", *win.lags(measure, spec, steps))
    return lagged.select("*", *[
        win.STATS[s](f"{measure}_lag_{lag}").over(spec.rowsBetween(-(n - 1), 0)).alias(
            f"{measure}_lag_{lag}_rolling_{s}_{n}")
        for lag, n in pairs for s in stats
    ])


def rolling_count_equal(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, value: float, pairs: Sequence[tuple[int, int]]
) -> DataFrame:
    """How often a lagged measure had a value in the last rows."""
    spec = win.series(keys, order)
    steps = sorted({lag for lag, _ in pairs})
    flags = [
        F.when(F.lag(measure, lag).over(spec) == value, 1).otherwise(0).alias(f"_hit_{lag}") for lag in steps
    ]
    return df.select("*", *flags).select("*", *[
        F.sum(f"_hit_{lag}").over(spec.rowsBetween(-(n - 1), 0)).alias(f"count_{value:g}_lag_{lag}_rolling_{n}")
        for lag, n in pairs
    ]).drop(*[f"_hit_{lag}" for lag in steps])


def diversity(df: DataFrame, keys: Sequence[str], order: str, item: str, spans: Sequence[int]) -> DataFrame:
    """Distinct items seen in the ``n`` periods before each period of a key, one row per key and period.

    An item counts from the period after it was seen until ``n`` periods later,
    or until it is seen again, when the next sighting takes over. So each
    sighting adds 1 where it starts to count and takes 1 away where it stops,
    and a running sum of these steps is the distinct count. No set is built: a
    key has one row per period with a sighting or a step. Null items are not
    counted.
    """
    seen = df.select(*keys, F.col(order).alias("_at"), F.col(item).alias("_item")).distinct()
    after = F.lead("_at").over(Window.partitionBy(*keys, "_item").orderBy("_at"))
    known = seen.where("_item IS NOT NULL").withColumn("_next", after)
    names = [f"{item}_last_{n}" for n in spans]
    steps = [F.struct(F.col("_at").alias("at"), F.lit(1).alias("real"), *[F.lit(0).alias(c) for c in names])]
    for n, name in zip(spans, names, strict=True):
        for at, by in ((F.col("_at") + 1, 1), (F.least(F.col("_at") + n, F.col("_next")) + 1, -1)):
            steps.append(F.struct(at.alias("at"), F.lit(0).alias("real"), *[
                F.lit(by if c == name else 0).alias(c) for c in names]))
    unseen = seen.where("_item IS NULL").select(*keys, F.inline(F.array(steps[0])))
    moved = known.select(*keys, F.inline(F.array(*steps))).unionByName(unseen).groupBy(*keys, "at").agg(
        F.max("real").alias("real"), *[F.sum(c).alias(c) for c in names])
    spec = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = moved.select(*keys, "at", "real", *[F.sum(c).over(spec).cast("bigint").alias(c) for c in names])
    return counted.where("real = 1").select(
        *keys, F.col("at").cast(df.schema[order].dataType).alias(order), *names)


def promo_runs(df: DataFrame, keys: Sequence[str], order: str, measure: str, gap: int = 2, name: str = "run_no") -> DataFrame:
    """Number the runs of a series.

    A new run starts after a gap of more than ``gap`` periods or where the
    ``gap`` rows before hold no sales; the first row has none before it.
    """
    spec = win.series(keys, order)
    step = F.coalesce(F.col(order) - F.lag(order).over(spec), F.lit(0))
    before = F.coalesce(F.sum(measure).over(spec.rowsBetween(-gap, -1)), F.lit(0.0))
    opens = ((step > gap) | (before == 0)).cast("int")
    return df.withColumn("_opens", opens).withColumn(name, win.running_sum("_opens", spec)).drop("_opens")


def high_low(df: DataFrame, keys: Sequence[str], measure: str, share: float, name: str) -> DataFrame:
    """High for the top share of rows by value inside the key, Low for the rest."""
    from aisle.operators.ordering import percent_ranks

    ranked = percent_ranks(df, keys, measure, "_rank")
    return ranked.withColumn(name, F.when(F.col("_rank") <= share, "High").otherwise("Low")).drop("_rank")


def cap_per_label(df: DataFrame, keys: Sequence[str], limit: int, row_id: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``limit`` rows per key and label, in a repeatable pseudo-random order (digest of seed and row id)."""
    order = [F.md5(F.concat_ws("|", F.lit(seed), *row_id)), *[F.col(c) for c in row_id]]
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(spec)).where(F.col("_rn") <= limit).drop("_rn")


def positive_run_length(df: DataFrame, keys: Sequence[str], order: str, measure: str) -> DataFrame:
    """Mean number of non-negative steps before a positive value turns negative."""
    spec = win.series(keys, order)
    after = F.lead(measure).over(spec)
    marked = df.select(
        *keys, order,
        ((F.col(measure) >= 0) & (after >= 0)).cast("int").alias("_step"),
        ((F.col(measure) > 0) & (after < 0)).cast("int").alias("_turn"),
    ).na.fill(0, ["_step", "_turn"])
    ahead = F.sum("_turn").over(spec.rowsBetween(0, Window.unboundedFollowing)) > 0
    return marked.withColumn("_counted", F.when(ahead, F.col("_step")).otherwise(0)).groupBy(*keys).agg(
        F.sum("_turn").alias("turns"), F.try_divide(F.sum("_counted"), F.sum("_turn")).alias("mean_run")
    )


def conditional_diff(
    df: DataFrame, keys: Sequence[str], order: str, condition: str, measure: str, n: int
) -> DataFrame:
    """Change of a measure over n hits; a hit is a negative condition after n rows that sum to at least 0."""
    spec = win.series(keys, order)
    frame = spec.rowsBetween(-n, -1)
    before = F.when(F.count(condition).over(frame) >= n, F.sum(condition).over(frame))
    hits = df.withColumn("_before", before).where((F.col(condition) < 0) & (F.col("_before") >= 0))
    return hits.select(*keys, order, win.difference(measure, spec, n).alias(f"{measure}_diff_{n}"))


def trend_stats(df: DataFrame, keys: Sequence[str], order: str, measure: str, cap: float = 100.0) -> DataFrame:
    """Period-on-period change in percent, held inside ±cap, and its mean per key."""
    spec = win.series(keys, order)
    before = F.lag(measure).over(spec)
    change = F.try_divide(F.col(measure) - before, before) * 100
    held = F.when(change.isNotNull(), F.least(F.greatest(change, F.lit(-cap)), F.lit(cap)))
    return df.withColumn("trend_pct", held).withColumn(
        "mean_trend_pct", F.avg("trend_pct").over(Window.partitionBy(*keys)))


def cumulative_share(df: DataFrame, keys: Sequence[str], order: str, measure: str) -> DataFrame:
    """Running total and running share of the key's total."""
    spec = win.series(keys, order)
    whole = F.sum(measure).over(Window.partitionBy(*keys))
    run = win.running_sum(measure, spec)
    return df.withColumns({"running": run, "running_share": F.try_divide(run, whole)})


def ratio_to_total(c: str, keys: Sequence[str]) -> Column:
    return F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy(*keys)))


def next_event_distance(
    df: DataFrame, keys: Sequence[str], event: str, start: str, end: str, name: str
) -> DataFrame:
    """Days from the end of an event to the start of the next one of its key, at least 0.

    Only the last event of a start date can have a later neighbour, so the
    window runs over the distinct dates of a key and never over its events.
    """
    dates = df.groupBy(*keys, start).agg(F.max(event).alias(event))
    following = F.lead(start).over(win.series(keys, start))
    nearest = dates.select(*keys, start, event, following.alias("_next"))
    gap = F.datediff("_next", end)
    return (
        df.join(nearest, [*keys, start, event], "left")
        .withColumn(name, F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)))
        .drop("_next")
    )
