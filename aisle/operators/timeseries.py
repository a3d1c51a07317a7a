"""Time-series steps on series that are aggregated to one row per key and period."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from aisle.functions import weeks, windows as win
from aisle.functions.exprs import beside, cap, ratio, safe_div
from aisle.session import checkpointed


def densify(
    df: DataFrame, keys: Sequence[str], day: str, measures: Sequence[str], step: str = "interval 1 day",
    end: Column | None = None,
) -> DataFrame:
    """All periods of each key from its first to its last (or to ``end``); missing measures are 0."""
    last = F.max(day) if end is None else end
    spans = df.groupBy(*keys).agg(F.min(day).alias("_from"), last.alias("_to"))
    full = spans.select(*keys, F.explode(F.sequence("_from", "_to", F.expr(step))).alias(day))
    return full.join(df, [*keys, day], "left").na.fill(0.0, list(measures))


def to_weekly(df: DataFrame, keys: Sequence[str], day: str, measure: str) -> DataFrame:
    """Totals per simple week, dated by the Thursday of the ISO week the simple week starts in."""
    start = F.min(day)
    return df.groupBy(*keys, weeks.simple_yearweek(day).alias("yearweek")).agg(
        F.sum(measure).alias(measure), F.date_add(F.trunc(start, "week"), 3).alias("anchor"))


def daily_average(measure: str, working_days: str) -> Column:
    """Measure per working day, 0 in a week without one."""
    return safe_div(measure, working_days)


def green_flag(df: DataFrame, product: Sequence[str], week: str, own: Column) -> DataFrame:
    """Promotion flag of a week, raised for all regions of a product where one region has it."""
    flagged = df.withColumn("green", own.cast("int"))
    return flagged.withColumn("green", F.max("green").over(Window.partitionBy(*product, week)))


def _yellow(c: str) -> Column:
    return F.when(F.col("green") == 0, F.col(c))


def _bounded(mean: Column, deviation: Column, c: str) -> Column:
    return cap(c, mean - deviation, mean + deviation)


def baseline_clean_v1(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Cap to mean ± deviation of promotion-free weeks, then to the 13-week mean ± deviation.

    Also gives the 13-week median and median absolute deviation.
    """
    spec, whole = win.series(keys, order), Window.partitionBy(*keys)
    first = df.withColumn("daily_original", F.col("daily")).withColumn(
        "daily", _bounded(F.avg(_yellow("daily")).over(whole), F.stddev_samp(_yellow("daily")).over(whole), "daily"))
    frame = spec.rowsBetween(-12, 0)
    rows = F.when(F.count("daily").over(frame) >= 13, F.collect_list("daily").over(frame))
    moving = first.select(
        "*", win.rolling_full("daily", spec, 13, F.avg).alias("ma"),
        win.rolling_full("daily", spec, 13, F.stddev_samp).alias("mstd"), F.array_sort(rows).alias("_rows"))
    middle = F.get("_rows", F.lit(6))
    spread = F.get(F.array_sort(F.transform("_rows", lambda x: F.abs(x - F.get(F.col("_rows"), F.lit(6))))), F.lit(6))
    return moving.select(
        *[c for c in moving.columns if c != "_rows"], middle.alias("mm"), spread.alias("mmad"),
        (middle + 2 * spread).alias("range_up_median"), (middle - 2 * spread).alias("range_down_median"),
    ).withColumn("baseline_daily", _bounded(F.col("ma"), F.col("mstd"), "daily")).withColumn(
        "baseline", F.col("baseline_daily") * F.col("working_days"))


def baseline_clean_52w(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Cap to the promotion-free mean ± deviation of the last 52 rows, then to 13 rows."""
    spec = win.series(keys, order)
    year = spec.rowsBetween(-51, 0)
    full = F.count(F.lit(1)).over(year) >= 52
    first = df.withColumn("daily_original", F.col("daily")).select(
        "*", F.when(full, F.avg(_yellow("daily")).over(year)).alias("ma_yellow"),
        F.when(full, F.stddev_samp(_yellow("daily")).over(year)).alias("mstd_yellow"))
    capped = first.withColumn("daily", _bounded(F.col("ma_yellow"), F.col("mstd_yellow"), "daily"))
    moving = capped.select(
        "*", win.rolling_full("daily", spec, 13, F.avg).alias("ma"),
        win.rolling_full("daily", spec, 13, F.stddev_samp).alias("mstd"))
    return moving.withColumn("baseline_daily", _bounded(F.col("ma"), F.col("mstd"), "daily")).withColumn(
        "baseline", F.col("baseline_daily") * F.col("working_days"))


def _full_frame(spec, start: int, stop: int, rows: int, value: Column) -> Column:
    frame = spec.rowsBetween(start, stop)
    return F.when(F.count(F.lit(1)).over(frame) >= rows, value.over(frame))


def _both_sides(left: Column, right: Column) -> Column:
    return F.coalesce((left + right) / 2, left, right)


def baseline_clean(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Two-stage baseline.

    Stage 1 caps to the mean of the promotion-free means 26 rows back and ahead
    (whichever exists) ± the deviation 26 rows back. Stage 2 caps the result to
    the mean of the six rows before and the six after ± their mean deviation.
    """
    spec = win.series(keys, order)
    back = _full_frame(spec, -25, 0, 26, F.avg(_yellow("daily")))
    ahead = _full_frame(spec, 0, 25, 26, F.avg(_yellow("daily")))
    first = df.withColumn("daily_original", F.col("daily")).select(
        "*", _both_sides(back, ahead).alias("ma_yellow"),
        _full_frame(spec, -25, 0, 26, F.stddev_samp(_yellow("daily"))).alias("mstd_yellow"))
    capped = first.withColumn("daily", _bounded(F.col("ma_yellow"), F.col("mstd_yellow"), "daily"))
    near = lambda stat: _both_sides(
        _full_frame(spec, -6, -1, 6, stat("daily")), _full_frame(spec, 1, 6, 6, stat("daily")))
    moving = capped.select("*", near(F.avg).alias("ma"), near(F.stddev_samp).alias("mstd"))
    return moving.withColumn("baseline_daily", _bounded(F.col("ma"), F.col("mstd"), "daily")).withColumn(
        "baseline", F.col("baseline_daily") * F.col("working_days"))


def month_position(df: DataFrame, keys: Sequence[str], anchor: str, week: str, unit: str = "month") -> DataFrame:
    """Number of weeks of the key's month (or quarter) and the week's place in it."""
    bucket = Window.partitionBy(*keys, F.trunc(anchor, unit))
    return df.select(
        "*", F.trunc(anchor, unit).alias(f"{unit}_start"), F.count(week).over(bucket).cast("int").alias("count_weeks"),
        F.row_number().over(bucket.orderBy(week)).alias("week_order"))


def phasing_ratio(df: DataFrame, keys: Sequence[str], week: str, anchor: str, measure: str, history: Column) -> DataFrame:
    """Usual share of a week in its month by (weeks in month, place in month); months of 4 or 5 weeks.

    Windows on the keys and something more need no shuffle on a frame dealt by the keys.
    """
    placed = month_position(df.withColumn("_hist", history), keys, anchor, week)
    known = F.when(F.col("_hist"), F.col(measure))
    total = F.sum(known).over(Window.partitionBy(*keys, "month_start"))
    alike = Window.partitionBy(*keys, "count_weeks", "week_order")
    used = F.col("_hist") & (F.col("count_weeks") >= 4)
    return placed.withColumn("_share", F.when(used, ratio(known, total))).select(
        "*", F.avg("_share").over(alike).alias("ratio_generic"), F.count_if(used).over(alike).alias("_used")
    ).where("_used > 0").drop("_hist", "_share", "_used")


def apply_phasing(df: DataFrame, keys: Sequence[str], month: str, forecast: str, share: str) -> Column:
    """Month total of the non-negative forecast spread by the share."""
    total = F.sum(F.greatest(F.col(forecast), F.lit(0.0))).over(Window.partitionBy(*keys, month))
    return total * F.col(share)


def trendline(df: DataFrame, keys: Sequence[str], order: str, measure: str, history: Column) -> DataFrame:
    """Straight line through all history blended 1 : 0.5 with the one through its last 26 rows.

    x is the rank of the period over history and future. The lines are fitted over
    the key's window, so the series are read once and move once.
    """
    spec, whole = win.series(keys, order), Window.partitionBy(*keys)
    past = F.when(F.col("_hist"), 1)
    marked = df.withColumn("_hist", history).select(
        "*", F.row_number().over(spec).alias("x"),
        (F.count(past).over(whole) - F.count(past).over(spec.rowsBetween(Window.unboundedPreceding, -1))).alias("_left"))
    x = F.col("x").cast("double")
    every = F.when(F.col("_hist"), F.col(measure))
    recent = F.when(F.col("_hist") & (F.col("_left") <= 26), F.col(measure))
    fitted = marked.select(
        *df.columns, "x", F.regr_slope(every, x).over(whole).alias("_s1"), F.regr_intercept(every, x).over(whole).alias("_i1"),
        F.regr_slope(recent, x).over(whole).alias("_s2"), F.regr_intercept(recent, x).over(whole).alias("_i2"))
    blend = lambda a, b: (F.col(a) + 0.5 * F.col(b)) / 1.5
    return fitted.select(
        *df.columns, "x", blend("_s1", "_s2").alias("slope"), blend("_i1", "_i2").alias("intercept"),
        (blend("_i1", "_i2") + blend("_s1", "_s2") * F.col("x")).alias("trendline"))


def trend_by_half(df: DataFrame, keys: Sequence[str], order: str, anchor: str, measure: str) -> DataFrame:
    """Line per half-year with at least 13 rows; other halves take the next fit, else the one before."""
    spec = win.series(keys, order)
    half = (F.year(anchor) * 2 + F.floor((F.month(anchor) - 1) / 6)).cast("int")
    indexed = df.select("*", F.row_number().over(spec).cast("double").alias("x"), half.alias("half"))
    fits = indexed.groupBy(*keys, "half").agg(
        F.when(F.count(measure) >= 13, F.regr_slope(measure, "x")).alias("slope"),
        F.when(F.count(measure) >= 13, F.regr_intercept(measure, "x")).alias("intercept"))
    by_half = win.series(keys, "half")
    filled = fits.select(*keys, "half", *[
        F.coalesce(win.backward_fill(c, by_half), win.forward_fill(c, by_half)).alias(c)
        for c in ("slope", "intercept")])
    return indexed.join(filled, [*keys, "half"]).withColumn(
        "trendline", (F.col("intercept") + F.col("slope") * F.col("x")) * F.col("working_days"))


def lifecycle_slopes(df: DataFrame, keys: Sequence[str], order: str, measure: str) -> DataFrame:
    """Slope and intercept of each ~26-row chunk of the series longer than 52 rows."""
    spec, whole = win.series(keys, order), Window.partitionBy(*keys)
    sized = df.select(
        *keys, F.row_number().over(spec).alias("x"), F.col(measure).alias("y"),
        F.count(F.lit(1)).over(whole).alias("_n")).where("_n > 52")
    chunks = F.floor(F.col("_n") / 26)
    size, rest, at = F.floor(F.col("_n") / chunks), F.col("_n") % chunks, F.col("x") - 1
    edge = rest * (size + 1)
    chunk = F.when(at < edge, F.floor(at / (size + 1))).otherwise(rest + F.floor((at - edge) / size))
    return (
        sized.withColumn("chunk", chunk.cast("int")).groupBy(*keys, "chunk")
        .agg(F.count("y").alias("rows"), F.regr_slope("y", F.col("x").cast("double")).alias("slope"),
             F.regr_intercept("y", F.col("x").cast("double")).alias("intercept"))
        .where("rows > 13")
    )


def cumsum_trend(df: DataFrame, keys: Sequence[str], order: str, measure: str, history: Column) -> DataFrame:
    """Forecast as the differences of a line fitted through the running total of history."""
    spec, whole = win.series(keys, order), Window.partitionBy(*keys)
    run = df.select(
        "*", F.row_number().over(spec).cast("double").alias("_x"), win.running_sum(measure, spec).alias("_run"))
    y = F.when(history, F.col("_run"))
    slope, start = F.regr_slope(y, "_x").over(whole), F.regr_intercept(y, "_x").over(whole)
    fitted = run.withColumn("_fit", start + slope * F.col("_x"))
    return fitted.select(*df.columns, (F.col("_fit") - F.lag("_fit").over(spec)).alias("yhat"))


def future_frame(df: DataFrame, keys: Sequence[str], week: str, count: int) -> DataFrame:
    """Every key with each of the ``count`` weeks after the last week of the history."""
    last = df.agg(F.max(week).alias("_last"))
    return (
        beside(df.select(*keys).distinct(), last)
        .select(*keys, F.explode(F.sequence(F.date_add("_last", 7), F.date_add("_last", 7 * count), F.expr("interval 7 days"))).alias(week))
    )


def ratio_phase(
    df: DataFrame, keys: Sequence[str], week: str, anchor: str, measure: str, working_days: str, unit: str, least: int
) -> DataFrame:
    """Share per selling day of a week in its month or quarter: mean, median and deviation by place."""
    placed = month_position(df, keys, anchor, week, unit)
    total = F.sum(measure).over(Window.partitionBy(*keys, f"{unit}_start"))
    share = ratio(ratio(measure, total), working_days)
    return (
        placed.withColumn("_share", share).where(F.col("count_weeks") >= least)
        .groupBy(*keys, "count_weeks", "week_order")
        .agg(F.avg("_share").alias("ratio_mean"), F.percentile("_share", 0.5).alias("ratio_median"),
             F.stddev_samp("_share").alias("ratio_std"))
        .where("ratio_median is not null")
    )


def normalized_phase(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Phase ratios scaled to sum to 1 over the places of a month or quarter."""
    total = F.sum(column).over(Window.partitionBy(*keys, "count_weeks"))
    return df.withColumn(f"{column}_normalized", ratio(column, total))


def sec_to_pri(
    df: DataFrame, keys: Sequence[str], category: str, months: Sequence[date]
) -> DataFrame:
    """Primary forecast of the given months from a secondary forecast.

    ``df`` has one row per key and week: ``week``, ``month_start``,
    ``working_days``, ``forecast`` (secondary) and ``primary`` (known primary
    sales, null later). The months run in order since each result feeds the
    ratios of the next ones; the state is cut by a checkpoint per month. A
    month's ratio is the category median of its keys' median shares per selling
    day over the 24 months before. Without months there are no rows.
    """
    bucket = Window.partitionBy(*keys, "month_start")
    known = checkpointed(df.select(
        *keys, category, "week", "month_start", "working_days", "forecast", F.col("primary").alias("value"),
        F.count("week").over(bucket).cast("int").alias("count_weeks"),
        F.row_number().over(bucket.orderBy("week")).alias("week_order")))
    done: DataFrame | None = None
    for month in months:
        first = F.lit(month)
        span = known.where(
            F.col("week").between(F.add_months(first, -24), F.date_add(F.add_months(first, -1), 27)))
        history = span.select(
            *keys, category, "week", "month_start", "working_days", F.coalesce("value", F.lit(0.0)).alias("value"))
        own = ratio_phase_of(history, keys)
        rows = known.where(F.col("month_start") == first)
        shares = rows.join(own, [*keys, "count_weeks", "week_order"], "left").groupBy(
            category, "count_weeks", "week_order").agg(F.percentile("ratio_median", 0.5).alias("_ratio"))
        total = F.sum("forecast").over(Window.partitionBy(*keys, "month_start"))
        converted = checkpointed(
            rows.withColumn("_total", total).join(shares, [category, "count_weeks", "week_order"], "left")
            .withColumn("value", F.col("_total") * F.col("_ratio") * F.col("working_days")).select(*known.columns))
        known = known.where(F.col("month_start") != first).unionByName(converted)
        done = converted if done is None else done.unionByName(converted)
    done = known.where("false") if done is None else done
    return done.select(*keys, category, "week", F.col("value").alias("primary_forecast"))


def last_full_months(df: DataFrame, month: str, count: int) -> list[date]:
    """The ``count`` months before the last one of the data, which may not be complete, in order."""
    last = df.agg(F.max(month)).first()[0]
    if last is None:
        return []
    places = [last.year * 12 + last.month - 1 - i for i in range(count, 0, -1)]
    return [date(p // 12, p % 12 + 1, 1) for p in places]


def ratio_phase_of(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median share per selling day by place in the month, months of at least 4 weeks in the history."""
    bucket = Window.partitionBy(*keys, "month_start")
    share = ratio(ratio("value", F.sum("value").over(bucket)), "working_days")
    return (
        history.select(
            *keys, share.alias("_share"), F.count("week").over(bucket).cast("int").alias("count_weeks"),
            F.row_number().over(bucket.orderBy("week")).alias("week_order"))
        .where("count_weeks >= 4").groupBy(*keys, "count_weeks", "week_order")
        .agg(F.percentile("_share", 0.5).alias("ratio_median"))
    )


def week_master(days: DataFrame) -> DataFrame:
    """Month each ISO week belongs to: the one that holds more of its days."""
    counted = days.groupBy(weeks.week_start("date").alias("week"), F.trunc("date", "month").alias("month_start")).agg(
        F.count("date").alias("_n"))
    return counted.groupBy("week").agg(F.max_by("month_start", "_n").alias("month_start"))


def ml_lag_features(df: DataFrame, keys: Sequence[str], order: str, measure: str, day: str) -> DataFrame:
    """First difference with its lags, lagged rolling and expanding means; year, month and ISO week of ``day`` in its place."""
    spec = win.series(keys, order)
    base = df.withColumn("diff", win.difference(measure, spec))
    columns = win.lags("diff", spec, [1, 2, 4, 13, 26, 52])
    for lag in (1, 2, 4, 13, 26):
        columns += [
            _full_frame(spec, -(lag + n - 1), -lag, n, F.avg("diff")).alias(f"diff_lag_{lag}_mean_{n}")
            for n in (4, 13, 26)
        ]
    columns.append(_full_frame(spec, -55, -52, 4, F.avg("diff")).alias("diff_lag_52_mean_4"))
    columns += [
        F.avg("diff").over(spec.rowsBetween(Window.unboundedPreceding, -lag)).alias(f"diff_lag_{lag}_expanding")
        for lag in (1, 2)
    ]
    parts = [F.year(day).alias("year"), F.month(day).alias("month"), F.weekofyear(day).alias("week")]
    return base.select(*[c for c in base.columns if c != day], *parts, *columns)


def indirect_features(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, means: Sequence[int], steps: Sequence[int]
) -> DataFrame:
    """Moving averages and the measure itself, lagged; early rows take the first value, short series 0."""
    spec, whole = win.series(keys, order), Window.partitionBy(*keys)
    base = df.select("*", F.count(F.lit(1)).over(whole).alias("_n"), *[
        F.coalesce(win.rolling_full(measure, spec, n, F.avg), F.lit(0.0)).alias(f"ma{n}_{measure}") for n in means])
    start = spec.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for c in [measure, *[f"ma{n}_{measure}" for n in means]]:
        first = F.first(c).over(start)
        out += [
            F.when(F.col("_n") > lag, F.coalesce(F.lag(c, lag).over(spec), first)).otherwise(0.0).alias(f"lag_{lag}_{c}")
            for lag in steps
        ]
    return base.select("*", *out).drop("_n")


def direct_features(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, horizon: int,
    steps: Sequence[int] = (0, 1, 2, 4), rolls: Sequence[int] = (4, 13),
) -> DataFrame:
    """Lags and rolling means that are all known ``horizon`` periods ahead."""
    spec = win.series(keys, order)
    return df.select(
        "*", *[
            F.max(measure).over(spec.rangeBetween(-(horizon + s), -(horizon + s))).alias(f"{measure}_lag_{horizon + s}")
            for s in steps],
        *[F.avg(measure).over(spec.rangeBetween(-(horizon + n - 1), -horizon)).alias(f"{measure}_mean_{n}_at_{horizon}")
          for n in rolls])


def recursive_forecast(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, lags: Sequence[int], horizon: int,
    predict: Callable[[DataFrame, dict[int, str]], DataFrame],
) -> DataFrame:
    """One-step forecasts fed back as the next step's lags, for all keys at once.

    A key is one row that carries its newest values in an array of the longest
    lag, so every step is a projection without a shuffle. ``predict`` gets the
    frame and the lag columns by number and must add ``prediction``; it may be a
    formula or the ``transform`` of a fitted Spark ML model.
    """
    longest = max(lags)
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    tail = df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= longest)
    state = tail.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, measure))), lambda r: r[measure]).alias("_state"),
        F.max(order).alias("_last")).where(F.size("_state") == longest)
    names = {n: f"lag_{n}" for n in lags}
    for _ in range(horizon):
        featured = state.select("*", *[F.element_at("_state", -n).alias(c) for n, c in names.items()])
        scored = predict(featured, names)
        state = scored.select(*keys, "_last", F.array_append("_state", F.col("prediction")).alias("_state"))
    steps = F.slice("_state", longest + 1, horizon)
    return state.select(*keys, "_last", F.posexplode(steps).alias("_i", "prediction")).select(
        *keys, (F.col("_i") + 1).alias("step"), (F.col("_last") + F.col("_i") + 1).alias(order), "prediction")


def rolling_folds(
    df: DataFrame, order: str, horizon: int, train: int | None = None, least: int = 1, roles: Sequence[str] = ("train", "test")
) -> DataFrame:
    """Rows dealt to the folds of a rolling origin: all columns, ``origin``, ``role`` and ``step``.

    The periods are the distinct values of ``order`` in the data, numbered from
    0. Each period with ``least`` periods before it (``train`` with a sliding
    window) and ``horizon`` periods from it on is an origin. Its test rows are
    those ``horizon`` periods (steps 1, 2, ...), its training rows the ``train``
    periods before it, or all of them without ``train`` (steps 0, -1, ...). A row
    finds its folds from the number of its period alone; a training row is
    copied for each, so a long expanding window is cheaper as running sums
    (see ``rolling_regression``). Rows without a period are left out.
    """
    periods = df.where(F.col(order).isNotNull()).select(order).distinct()
    numbered = periods.select(order, (F.row_number().over(Window.orderBy(order)) - 1).alias("_at"))  # one row per period
    lowest, highest = F.lit(least if train is None else max(train, least)), F.col("_size").cast("int") - horizon
    reach = {"test": (F.col("_at") - (horizon - 1), F.col("_at")),
             "train": (F.col("_at") + 1, highest if train is None else F.col("_at") + train)}
    sized = beside(numbered, numbered.agg(F.count(order).alias("_size")))
    spans = [F.struct(
        F.lit(role).alias("role"), F.greatest(reach[role][0], lowest).alias("_from"), F.least(reach[role][1], highest).alias("_to"))
        for role in roles]
    folds = sized.select(order, "_at", F.inline(F.array(*spans))).where("_from <= _to").select(
        order, "_at", "role", F.explode(F.sequence("_from", "_to")).alias("_fold"))
    origins = numbered.select(F.col(order).alias("origin"), F.col("_at").alias("_fold"))
    dealt = folds.join(origins, "_fold").select(order, "origin", "role", (F.col("_at") - F.col("_fold") + 1).alias("step"))
    return df.join(dealt, order)


def rolling_regression(
    df: DataFrame, order: str, label: str, columns: Sequence[str], horizon: int, train: int | None = None, least: int = 1
) -> DataFrame:
    """Least-squares model of every origin and its predictions: test rows with ``origin``, ``step``, ``prediction``.

    Sums and products of the columns are taken once per period; running sums
    over the periods (all before an origin, or the ``train`` before it) are all
    that a model needs, so the rows are read once however many origins there
    are. Origins as in ``rolling_folds``. A model without a unique solution
    takes the smallest one. Rows with a null column or label are left out.
    """
    whole = df.na.drop(subset=[order, label, *columns])
    names = ["_one", *columns, label]
    values = {"_one": F.lit(1.0), **{c: F.col(c).cast("double") for c in (*columns, label)}}
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = whole.groupBy(order).agg(*[F.sum(values[names[i]] * values[names[j]]).alias(f"_s{i}_{j}") for i, j in pairs])
    spec = Window.orderBy(order).rowsBetween(-train if train else Window.unboundedPreceding, -1)  # one row per period
    before = sums.select(F.col(order).alias("origin"), F.array(*[F.sum(f"_s{i}_{j}").over(spec) for i, j in pairs]).alias("sums"))
    schema = f"origin {df.schema[order].dataType.simpleString()}, weights array<double>"

    def solve(batches):
        for batch in batches:
            held = batch[batch["sums"].map(lambda x: x is not None and x[0] == x[0])]
            out = []
            for flat in held["sums"]:
                gram = np.zeros((len(names), len(names)))
                for (i, j), v in zip(pairs, flat, strict=True):
                    gram[i, j] = gram[j, i] = v
                # Scaled to a unit diagonal, so that the units of the columns do not matter.
                unit = 1 / np.sqrt(np.maximum(np.diag(gram)[:-1], 1e-300))
                scaled = gram[:-1, :-1] * unit[:, None] * unit[None, :]
                out.append(np.linalg.lstsq(scaled, gram[:-1, -1] * unit, rcond=1e-12)[0] * unit)
            yield pd.DataFrame({"origin": held["origin"], "weights": out})

    models = before.where(F.col("sums")[0].isNotNull()).mapInPandas(solve, schema)
    tests = rolling_folds(whole, order, horizon, train, least, ["test"]).join(models, "origin")
    terms = [F.col("weights")[0], *[F.col("weights")[i] * F.col(c) for i, c in enumerate(columns, 1)]]
    return tests.withColumn("prediction", sum(terms[1:], terms[0])).drop("weights", "role")


def backtest_lags(
    forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], order: str, measure: str, keep: Sequence[int]
) -> DataFrame:
    """Forecasts of some steps after their cutoff next to the actuals; missing actuals are 0."""
    kept = forecasts.withColumn("lag_fc", F.col(order) - F.col("cutoff")).where(F.col("lag_fc").isin(*keep))
    known = actuals.select(*keys, order, F.col(measure).alias("actual"))
    return kept.join(known, [*keys, order], "left").na.fill({"actual": 0.0})


def performance_features(df: DataFrame, pairs: dict[str, Sequence[str]], measure: str) -> DataFrame:
    """Sums of a feature over several groupings, joined back to each row.

    Group sums are aggregated map-side first; a window over a wide group would
    gather all its rows in one task.
    """
    out = df
    for name, keys in pairs.items():
        out = out.join(df.groupBy(*keys).agg(F.sum(measure).alias(name)), list(keys), "left")
    return out


def active_days(df: DataFrame, keys: Sequence[str], day: str, measure: str, steps: Sequence[int]) -> DataFrame:
    """Days with sales per simple week and earlier weeks' values."""
    weekly = df.groupBy(*keys, weeks.simple_yearweek(day).alias("yearweek")).agg(
        F.count_if(F.col(measure) > 0).alias("active_days"))
    spec = win.series(keys, "yearweek")
    return weekly.select("*", *win.lags("active_days", spec, steps))


def route_series(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Model class of a series by mean sales and number of days."""
    stats = df.groupBy(*keys).agg(F.avg(measure).alias("mean_sales"), F.count(F.lit(1)).alias("days"))
    route = (
        F.when(F.col("mean_sales") < 1, "low_performance").when(F.col("days") < 91, "low_num_of_days")
        .when(F.col("days") >= 300, "normal_and_auto").otherwise("normal")
    )
    return stats.withColumn("route", route)


def time_split(df: DataFrame, keys: Sequence[str], order: str, share: float, name: str = "part") -> DataFrame:
    """Mark the oldest share of each series as train, the rest as test."""
    spec, whole = win.series(keys, order), Window.partitionBy(*keys)
    edge = F.floor(F.count(F.lit(1)).over(whole) * F.lit(share))
    return df.withColumn(name, F.when(F.row_number().over(spec) <= edge, "train").otherwise("test"))


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, measure: str, lags: int) -> DataFrame:
    """Autocorrelation and partial autocorrelation per lag, and the unit-root t-value without lags."""
    spec = win.series(keys, order)
    before = F.lag(measure).over(spec)
    base = df.select(
        *keys, F.col(measure).alias("y"), before.alias("_x"), (F.col(measure) - before).alias("_d"),
        *[F.lag(measure, k).over(spec).alias(f"_l{k}") for k in range(1, lags + 1)])
    paired = F.when(F.col("_d").isNotNull(), F.col("_x"))
    slope = F.regr_slope("_d", "_x")
    n = F.count("_d")
    left = F.regr_syy("_d", "_x") - slope * slope * F.regr_sxx("_d", "_x")
    stats = base.groupBy(*keys).agg(
        *[F.corr("y", f"_l{k}").alias(f"acf_{k}") for k in range(1, lags + 1)], F.count(paired).alias("_n"),
        (slope / F.sqrt(left / (n - 2) / F.regr_sxx("_d", "_x"))).alias("unit_root_t"))
    # Levinson-Durbin recursion over the lags.
    phi: dict[tuple[int, int], Column] = {}
    for k in range(1, lags + 1):
        top = F.col(f"acf_{k}")
        bottom = F.lit(1.0)
        for j in range(1, k):
            top = top - phi[k - 1, j] * F.col(f"acf_{k - j}")
            bottom = bottom - phi[k - 1, j] * F.col(f"acf_{j}")
        stats = stats.withColumn(f"pacf_{k}", ratio(top, bottom))
        phi[k, k] = F.col(f"pacf_{k}")
        inner = {f"_phi_{k}_{j}": phi[k - 1, j] - F.col(f"pacf_{k}") * phi[k - 1, k - j] for j in range(1, k)}
        if inner:
            stats = stats.withColumns(inner)
        for j in range(1, k):
            phi[k, j] = F.col(f"_phi_{k}_{j}")
    return stats.select(
        *keys, *[f"acf_{k}" for k in range(1, lags + 1)], *[f"pacf_{k}" for k in range(1, lags + 1)], "unit_root_t")


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], dict], fields: str) -> DataFrame:
    """Run an Arrow function per series; an error becomes a row with its text instead of failing the job.

    For steps without a SQL form, on series bounded by their number of periods.
    ``fn`` takes the table of a series and returns one value, or a list of
    values, for each field.
    """
    schema = StructType([
        *[StructField(k, df.schema[k].dataType) for k in keys], *StructType.fromDDL(fields).fields,
        StructField("error", StringType())])
    arrow, names = to_arrow_schema(schema), StructType.fromDDL(fields).names

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        error = None
        try:
            out = fn(table)
        except Exception as problem:  # the row carries it
            out, error = dict.fromkeys(names), f"{type(problem).__name__}: {problem}"
        values = {n: v if isinstance(v := out[n], (list, tuple, np.ndarray)) else [v] for n in names}
        rows = max((len(v) for v in values.values()), default=0)
        same = {k: [v.as_py()] * rows for k, v in zip(keys, key, strict=True)}
        return pa.Table.from_pydict({**same, **values, "error": [error] * rows}, schema=arrow)

    return df.groupBy(*keys).applyInArrow(run, schema)


def smoothed(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, grid: Sequence[float], least: int = 3
) -> DataFrame:
    """Exponential smoothing of each series with the factor of the smallest squared one-step error.

    One row per series: ``alpha`` (ties: the smaller), ``level`` (the forecast of
    the next period), ``mse`` of the one-step forecasts, ``periods`` and
    ``error``. The level starts at the first value, and all factors run along the
    series together. A series with fewer than ``least`` periods or with a
    missing value has an error and nothing else.
    """
    factors = np.array(sorted(grid))

    def search(table: pa.Table) -> dict:
        values = table.sort_by(order).column(measure).to_pylist()
        if len(values) < least:
            raise ValueError(f"{len(values)} of {least} periods")
        if any(v is None or v != v for v in values):
            raise ValueError("missing value")
        level, error = np.full(len(factors), float(values[0])), np.zeros(len(factors))
        for v in values[1:]:
            miss = v - level
            error += miss * miss
            level = level + factors * miss
        best = int(error.argmin())
        return {"alpha": float(factors[best]), "level": float(level[best]), "mse": float(error[best] / (len(values) - 1)),
                "periods": len(values)}

    return map_groups(df.select(*keys, order, measure), keys, search, "alpha double, level double, mse double, periods bigint")


def sec_pri_ratio(df: DataFrame, keys: Sequence[str], week: str, order: str) -> DataFrame:
    """Gap of secondary to primary sales by week, month and quarter, and its moving means."""
    spec = win.series(keys, order)
    out = df
    for unit in ("month", "quarter"):
        bucket = Window.partitionBy(*keys, F.trunc(week, unit))
        total = lambda c: F.sum(c).over(bucket)  # noqa: E731,B023
        out = out.withColumn(f"ratio_{unit}", ratio(total("secondary") - total("primary"), total("primary")))
    out = out.withColumn("ratio_week", ratio(F.col("secondary") - F.col("primary"), "primary"))
    mean = lambda c, n: F.when(
        F.count(c).over(spec.rowsBetween(-(n - 1), 0)) >= n, F.avg(c).over(spec.rowsBetween(-(n - 1), 0)))
    return out.select(
        "*", mean("ratio_week", 4).alias("ma_week_month"), mean("ratio_week", 13).alias("ma_week_quarter"),
        mean("ratio_month", 3).alias("ma_month_quarter"))


def seasonal_index(df: DataFrame, period: str, year: str, value: str, spans: Sequence[int]) -> DataFrame:
    """Mean ratio per period over all years (``index_all``) and over the last n years (``index_{n}y``).

    The ratio is averaged over the rows of a year first; a year of the data
    without the period counts as 0. The last year is that of the data.
    """
    yearly = df.groupBy(period, year).agg(F.avg(value).alias("_mean"))
    known = yearly.agg(F.max(year).alias("_last"), F.count_distinct(year).alias("_years"))
    recent = lambda n: F.sum(F.when(F.col(year) > F.col("_last") - n, F.col("_mean")))
    return beside(yearly, known).groupBy(period).agg(
        (F.sum("_mean") / F.max("_years")).alias("index_all"),
        *[(F.coalesce(recent(n), F.lit(0.0)) / n).alias(f"index_{n}y") for n in spans])


def ratio_from_forecast(df: DataFrame, keys: Sequence[str], anchor: str, forecast: str, working_days: str) -> DataFrame:
    """Share per selling day in the month and quarter, taken from a forecast."""
    per_day = ratio(forecast, working_days)
    share = lambda unit: ratio(
        per_day, F.sum(forecast).over(Window.partitionBy(*keys, F.trunc(anchor, unit))))
    return df.select("*", share("month").alias("ratio_week_month"), share("quarter").alias("ratio_week_quarter"))


def holiday_context(calendar: DataFrame, week: str, name: str, reach: int, names: Sequence[str]) -> DataFrame:
    """Holiday flags of the weeks around each calendar week; week 53 and the normal weeks are left out."""
    spec = Window.orderBy(week)  # one row per calendar week
    base = calendar.where(F.col("yearweek") % 100 != 53)
    near = {"": F.col(name)}
    for k in range(1, reach + 1):
        near[f"_past_{k}"] = F.lag(name, k).over(spec)
        near[f"_forward_{k}"] = F.lead(name, k).over(spec)
    moved = base.select(week, "yearweek", *[c.alias(f"_h{suffix}") for suffix, c in near.items()])
    return moved.select(week, "yearweek", *[
        F.coalesce(F.col(f"_h{suffix}") == n, F.lit(False)).cast("int").alias(f"holiday{suffix}_{n}")
        for suffix in near for n in names])
