"""Promotion expansion, classes, benefits and the uplift phasing chain.

The chain works on weekly rows of a promoted material (category, dp, material,
week): ``pri_sales``, ``sec_sales`` of the material, ``pri_sales_dp`` of its
whole product and ``baseline`` of the product. Its windows run inside one
material's weeks or one product-week's materials.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions import weeks
from aisle.functions.exprs import ratio, safe_div
from aisle.operators.aggregates import distinct_values, robust_mode
from aisle.operators.windows import promo_runs

SERIES = ["category", "dp", "material"]
PRODUCT = ["category", "dp"]
RUN = [*SERIES, "run_no"]


def promo_weeks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Promoted days, schemes, highest and mean discount per key and ISO week.

    A scheme is expanded to its weeks, not to its days; the days in a week are
    counted from the overlap.
    """
    first, last = F.trunc("start_date", "week"), F.trunc("end_date", "week")
    spread = df.select(
        *keys, "scheme", "discount", "start_date", "end_date",
        F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("week"))
    days = F.datediff(
        F.least("end_date", F.date_add("week", 6)), F.greatest(F.col("start_date"), F.col("week"))) + 1
    daily = spread.select(*keys, "scheme", "discount", "week", days.alias("_days"))
    return daily.groupBy(*keys, "week").agg(
        F.count("scheme").alias("schemes"), F.sum("_days").alias("scheme_days"),
        F.max("discount").alias("max_discount"),
        ratio(F.sum(F.col("discount") * F.col("_days")), F.sum("_days")).alias("mean_discount"))


def scheme_types(df: DataFrame, keys: Sequence[str], kind: str, scheme: str) -> DataFrame:
    """SINGLE, PROGRESSIVE, HYBRID or ON_TOP by distinct schemes and lines per key and kind."""
    stats = df.groupBy(*keys, kind).agg(
        F.count_distinct(scheme).alias("scheme_unique_count"), F.count(scheme).alias("scheme_count"))
    unique, rows = F.col("scheme_unique_count"), F.col("scheme_count")
    label = (
        F.when((unique == 1) & (rows == 1), "SINGLE").when(unique == 1, "PROGRESSIVE")
        .when(unique < rows, "HYBRID").otherwise("ON_TOP")
    )
    return stats.select("*", label.alias("scheme_type"), F.concat_ws("_", label, F.col(kind)).alias("promotion_type"))


def feature_matrix(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines in all and by kind, distinct schemes by buy type and by week type, and discount statistics, in one aggregation.

    The values of ``kind``, ``buy`` and ``week_type`` are those of the data, in
    order; each has a numbered column.
    """
    kinds, buys, types = (distinct_values(df, c) for c in ("kind", "buy", "week_type"))
    own = lambda c, v: F.count_distinct(F.when(F.col(c).eqNullSafe(F.lit(v)), F.col("scheme")))
    return df.groupBy(*keys).agg(
        F.count("*").alias("promotions"),
        *[F.count_if(F.col("kind").eqNullSafe(F.lit(k))).alias(f"kind_{i}") for i, k in enumerate(kinds, 1)],
        *[own("buy", b).alias(f"buy_{i}") for i, b in enumerate(buys, 1)],
        *[own("week_type", w).alias(f"week_type_{i}") for i, w in enumerate(types, 1)],
        F.coalesce(F.min("discount"), F.lit(0.0)).alias("discount_min"),
        F.coalesce(F.max("discount"), F.lit(0.0)).alias("discount_max"),
        F.coalesce(F.avg("discount"), F.lit(0.0)).alias("discount_mean"),
        F.max(F.col("holiday").cast("int")).alias("holiday"))


def investment_counts(df: DataFrame, keys: Sequence[str], scheme: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Schemes per investment type and week; types outside the list count as other."""
    flags = [F.max((F.col(kind) == k).cast("int")).alias(f"type_{i}") for i, k in enumerate(kinds, 1)]
    other = F.max((~F.col(kind).isin(*kinds)).cast("int")).alias("type_other")
    per_scheme = df.groupBy(*keys, scheme).agg(*flags, other)
    names = [*[f"type_{i}" for i in range(1, len(kinds) + 1)], "type_other"]
    return per_scheme.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def _unit_price(uom: str, prefix: str) -> Column:
    unit = F.col(uom)
    return (
        F.when(unit == "SU", F.col(f"{prefix}_su")).when(unit == "CS", F.col(f"{prefix}_cs"))
        .otherwise(F.col(f"{prefix}_pc"))
    )


def benefit() -> list[Column]:
    """Money value of a promotion and its value per minimum buy, by mechanic and unit."""
    mechanic, money = F.col("mechanic_type"), F.col("min_buy_uom") == "VND"
    pct, least = F.col("pct_discount"), F.col("min_buy")
    gift = F.col("gift_qty") * _unit_price("gift_uom", "gift_price")
    is_gift = mechanic.isin("U GIFT", "NON-U GIFT")
    whole = (
        F.when(mechanic == "PERCENTAGE", pct * least * F.when(money, 1.0).otherwise(_unit_price("min_buy_uom", "price")) / 100)
        .when(mechanic == "VALUE", F.col("val_discount")).when(is_gift, gift).otherwise(0.0)
    )
    scale = F.when(money, 1000.0).otherwise(1.0)
    per_buy = (
        F.when(mechanic == "PERCENTAGE", pct / least * scale).when(mechanic == "VALUE", F.col("val_discount") / least)
        .when(is_gift, gift / least * scale).otherwise(0.0)
    )
    return [whole.alias("benefit"), per_buy.alias("benefit_per_min_buy")]


def effective_deals(df: DataFrame, closed: Sequence[str]) -> DataFrame:
    """Deals with their real end: the stop date unless 0. Closed deals and ends before the start drop out."""
    as_date = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    end = F.when(F.col("stop_date") != 0, F.col("stop_date")).otherwise(F.col("orig_end_date"))
    dated = df.withColumn("_end", end).withColumns({"start": as_date("start_date"), "end": as_date("_end")}).drop("_end")
    return dated.where(~F.col("deal_status").isin(*closed) & (F.col("end") >= F.col("start")))


def banded_correction(df: DataFrame, bom: DataFrame) -> DataFrame:
    """Replace a banded material's sales by its banded sales and take the banded total off its base material."""
    mapped = df.join(bom, "material", "left")
    week = Window.partitionBy(*PRODUCT, "week")
    value = F.coalesce("banded_sales", "sales")
    frame = mapped.select(
        *df.columns, value.alias("_value"), F.max("base_material").over(week).alias("_base"),
        F.sum("banded_sales").over(week).alias("_banded"))
    corrected = F.when(
        (F.col("material") == F.col("_base")) & (F.col("_banded") > 0), F.col("_value") - F.col("_banded")
    ).otherwise(F.col("_value"))
    return frame.withColumn("sales_corrected", corrected).drop("_value", "_base", "_banded")


def uplift(df: DataFrame) -> DataFrame:
    """Product uplift, material contribution, and runs below 1 % of the material's sales set to zero."""
    total = F.sum("pri_sales").over(Window.partitionBy(*SERIES))
    runs = promo_runs(df, SERIES, "week_no", "pri_sales", name="_run")
    share = ratio(F.sum("pri_sales").over(Window.partitionBy(*SERIES, "_run")), total)
    return runs.select(
        *df.columns, safe_div("pri_sales", "pri_sales_dp").alias("contribution"),
        (F.col("pri_sales_dp") - F.col("baseline")).alias("uplift"), share.alias("_share")
    ).withColumn("pri_sales", F.when(F.col("_share") < 0.01, 0.0).otherwise(F.col("pri_sales"))).drop("_share")


def numbered_runs(df: DataFrame) -> DataFrame:
    """Promotion runs of each material."""
    return promo_runs(df, SERIES, "week_no", "pri_sales")


def preload(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Mark the first rows of each run until the cumulative primary share reaches ``share``.

    Runs without sales drop out. ``preload_sum`` is the primary volume up to the
    end of the preload.
    """
    run = Window.partitionBy(*RUN)
    ordered = run.orderBy("week_no")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("pri_sales").over(run)
    cumulated = df.select(
        "*", F.row_number().over(ordered).alias("_at"),
        F.coalesce(ratio(F.sum("pri_sales").over(up_to), total), F.lit(0.0)).alias("cum_share"),
        F.sum("pri_sales").over(up_to).alias("cum_pri"), F.sum("sec_sales").over(up_to).alias("cum_sec"))
    reached = F.when(F.col("cum_share") >= share, F.col("_at"))
    ended = cumulated.withColumn("_end", F.min(reached).over(run)).where("_end is not null")
    inside = F.col("_at") <= F.col("_end")
    return ended.select(
        *df.columns, "cum_share", "cum_pri", "cum_sec",
        F.when(inside, F.col("uplift")).otherwise(0.0).alias("preload_volume"),
        F.when(inside, F.col("_end")).otherwise(0).alias("preload_length"),
        F.when(inside, F.min("week").over(run)).alias("preload_start"),
        F.when(inside, F.max(F.when(inside, F.col("week"))).over(run)).alias("preload_end"),
        F.max(F.when(inside, F.col("cum_pri"))).over(run).alias("preload_sum"))


def shift_leading(df: DataFrame, keep: Column) -> DataFrame:
    """Move the sales of leading preload weeks that fail ``keep`` into the first week that passes.

    If none passes, the last preload week takes them.
    """
    block = Window.partitionBy(*RUN, F.col("preload_length") > 0)
    marked = df.select(
        "*", (F.col("preload_length") > 0).alias("_pre"),
        (F.row_number().over(block.orderBy("week_no")) - 1).alias("_idx"), keep.alias("_keep"))
    target = F.coalesce(
        F.min(F.when(F.col("_keep"), F.col("_idx"))).over(block), F.max("_idx").over(block))
    placed = marked.withColumn("_to", F.when(F.col("_pre"), target).otherwise(0))
    leading = F.col("_pre") & (F.col("_idx") < F.col("_to"))
    moved = lambda c: F.sum(F.when(leading, F.col(c)).otherwise(0.0)).over(block)
    here = F.col("_pre") & (F.col("_idx") == F.col("_to"))
    new = lambda c: F.when(leading, 0.0).when(here, F.col(c) + moved(c)).otherwise(F.col(c))
    return placed.select(
        *[c for c in df.columns if c not in ("pri_sales", "sec_sales", "preload_length", "preload_volume")],
        new("pri_sales").alias("pri_sales"), new("sec_sales").alias("sec_sales"),
        F.when(leading, 0).when(F.col("_pre"), F.col("preload_length") - F.col("_to")).otherwise(0).alias("preload_length"),
        F.when(leading, 0.0).otherwise(F.col("preload_volume")).alias("preload_volume"))


def shift_preload(df: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Shift leading weeks with negative uplift, then those below ``threshold`` cumulative share."""
    first = shift_leading(df, F.col("uplift") >= 0)
    return shift_leading(first, F.col("cum_share") >= threshold)


def postload(df: DataFrame) -> DataFrame:
    """Mark the rows after the preload until cumulative secondary sales reach the preload's primary sum.

    ``postload_length`` is null where they never do.
    """
    rows = df.where("not (pri_sales = 0 and sec_sales = 0)")
    run = Window.partitionBy(*RUN)
    placed = rows.withColumn("_at", F.row_number().over(run.orderBy("week_no")))
    end = F.min(F.when(F.col("cum_sec") >= F.col("preload_sum"), F.col("_at"))).over(run)
    pre = F.max("preload_length").over(run)
    # Rows past the end stay null unless they belong to the preload.
    length = F.when(F.col("preload_length") > 0, 0).when(F.col("_at") <= F.col("_end"), F.col("_end") - F.col("_pre"))
    return placed.withColumns({"_end": end, "_pre": pre}).withColumn("postload_length", length).withColumn(
        "postload_volume", F.when(F.col("postload_length") != 0, F.col("uplift")).otherwise(0.0)).drop("_at", "_end", "_pre")


def resolve_overlaps(df: DataFrame) -> DataFrame:
    """One product-week counts once: a preload beats a postload, several materials share by contribution."""
    week = Window.partitionBy(*PRODUCT, "week_no")
    both = (F.sum("preload_volume").over(week) != 0) & (F.sum("postload_volume").over(week) != 0)
    first = df.withColumn("_post", F.when(both, 0.0).otherwise(F.col("postload_volume")))

    def shared(c: str) -> Column:
        alone = F.sum(c).over(week) == F.max(F.when(F.col(c) != 0, F.col(c))).over(week)
        return F.when(F.coalesce(alone, F.lit(False)), F.col(c)).otherwise(F.col(c) * F.col("contribution"))

    return first.withColumns({"_pre_new": shared("preload_volume"), "_post_new": shared("_post")}).select(
        *[c for c in df.columns if c not in ("preload_volume", "postload_volume")],
        F.col("_pre_new").alias("preload_volume"), F.col("_post_new").alias("postload_volume"),
    ).where("preload_length > 0 or postload_length > 0")


def uplift_ratios(df: DataFrame) -> DataFrame:
    """Preload and postload volume of a run against the baseline in its span, and weekly shares of the product."""
    rows = df.where("postload_length is not null")
    run = Window.partitionBy(*RUN)
    inside = {"preload": F.col("preload_length") > 0, "postload": F.col("postload_length") > 0}
    out = rows
    for name, test in inside.items():
        out = out.withColumns({
            f"{name}_base": F.coalesce(F.sum(F.when(test, F.col("baseline"))).over(run), F.lit(0.0)),
            f"{name}_sum": F.sum(f"{name}_volume").over(run),
            f"{name}_weekly": F.when(
                test, F.coalesce(ratio("pri_sales_dp", F.sum(F.when(test, F.col("pri_sales_dp"))).over(run)), F.lit(0.0))
            ).otherwise(0.0),
        })
    volume = F.col("preload_sum_volume") + F.col("postload_sum_volume")
    named = out.withColumnsRenamed({"preload_sum": "preload_sum_volume", "postload_sum": "postload_sum_volume"})
    return named.withColumns({
        "preload_ratio": safe_div("preload_sum_volume", "preload_base"),
        "postload_ratio": safe_div("postload_sum_volume", "postload_base"),
        "uplift_ratio": ratio(volume, F.col("preload_base") + F.col("postload_base")),
    })


def phasing_curve(df: DataFrame, part: str) -> DataFrame:
    """Usual weekly shares of a preload or postload: the modal length's mean and median by position, scaled to 1."""
    length, weekly = f"{part}_length", f"{part}_weekly"
    active = df.where(F.col(length) > 0)
    lengths = active.select(*RUN, length).distinct()
    usual = robust_mode(lengths, PRODUCT, length, "_mode")
    chosen = active.join(usual, PRODUCT).where(F.col(length) == F.col("_mode"))
    placed = chosen.withColumn("position", F.row_number().over(Window.partitionBy(*RUN).orderBy("week_no")))
    curve = placed.groupBy(*PRODUCT, "position").agg(
        F.avg(weekly).alias("share_mean"), F.percentile(weekly, 0.5).alias("share_median"))
    whole = Window.partitionBy(*PRODUCT)
    return curve.select(
        *PRODUCT, F.lit(part.upper()).alias("type"), "position",
        safe_div("share_mean", F.sum("share_mean").over(whole)).alias("phasing_mean"),
        safe_div("share_median", F.sum("share_median").over(whole)).alias("phasing_median"))


def run_volumes(df: DataFrame) -> DataFrame:
    """Mean and median preload and postload ratio of a product's runs."""
    per_run = df.select(*RUN, "preload_ratio", "postload_ratio").distinct()
    return per_run.groupBy(*PRODUCT).agg(
        F.avg("preload_ratio").alias("preload_mean"), F.percentile("preload_ratio", 0.5).alias("preload_median"),
        F.avg("postload_ratio").alias("postload_mean"), F.percentile("postload_ratio", 0.5).alias("postload_median"))


def apply_curve(curve: DataFrame, volumes: DataFrame, starts: DataFrame) -> DataFrame:
    """Weekly promotion volume shares of future promotions.

    A start on a Sunday moves to the Monday after it; position n is n − 1 weeks
    later.
    """
    start = F.when(F.weekday("start_date") == 6, F.date_add("start_date", 1)).otherwise(F.col("start_date"))
    pre = F.col("type") == "PRELOAD"
    joined = starts.select(*PRODUCT, start.alias("start_date")).distinct().join(curve, PRODUCT).join(volumes, PRODUCT)
    week = F.trunc(F.date_add("start_date", (F.col("position") - 1) * 7), "week")
    return joined.select(
        *PRODUCT, "start_date", "type", "position", week.alias("week"), weeks.iso_yearweek(week).alias("yearweek"),
        (F.col("phasing_mean") * F.when(pre, F.col("preload_mean")).otherwise(F.col("postload_mean"))).alias("volume_mean"),
        (F.col("phasing_median") * F.when(pre, F.col("preload_median")).otherwise(F.col("postload_median"))).alias(
            "volume_median"))


def total_forecast(baseline: DataFrame, applied: DataFrame) -> DataFrame:
    """Baseline plus promotion volume: the share of the baseline summed over the promotion's span.

    Overlapping promotions of a product add up per week.
    """
    joined = applied.join(baseline, [*PRODUCT, "week"])
    span = F.sum("forecast").over(Window.partitionBy(*PRODUCT, "start_date", "type"))
    volume = joined.select(
        *PRODUCT, "week", (span * F.col("volume_mean")).alias("_mean"), (span * F.col("volume_median")).alias("_median")
    ).groupBy(*PRODUCT, "week").agg(F.sum("_mean").alias("_mean"), F.sum("_median").alias("_median"))
    add = lambda c: F.col("forecast") + F.coalesce(F.col(c), F.lit(0.0))
    return baseline.join(volume, [*PRODUCT, "week"], "left").select(
        *PRODUCT, "week", "forecast", add("_mean").alias("total_mean"), add("_median").alias("total_median"))


def impact_class(text: Column) -> Column:
    """Price, gift or both, from the promotion grouping."""
    both = F.arrays_overlap(F.split(text, " "), F.array(F.lit("discount"))) & F.arrays_overlap(
        F.split(text, " "), F.array(F.lit("gift")))
    return F.when(both, "gift+price").when(text.contains("gift"), "gift").when(
        text.contains("discount"), "price").otherwise("0")


def post_mart(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Daily demand of a promotion post as one row: span, totals and means."""
    return df.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("days"),
        *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(f"{c}_mean") for c in means])


def uplift_classes(df: DataFrame, sales: str, baseline: str, history: Column) -> DataFrame:
    """Absolute and relative uplift and its sign; history beyond ±100 % drops out."""
    gap = F.col(sales) - F.col(baseline)
    share = F.when(F.col(baseline) == 0, 0.0).otherwise(gap / F.col(baseline))
    return df.select(
        "*", gap.alias("abs_uplift"), share.alias("pct_uplift"), (gap >= 0).cast("int").alias("uplift_class")
    ).where(F.col("pct_uplift").between(-1, 1) | ~history)


def transform_uplift(
    df: DataFrame, keys: Sequence[str], sign: str, share: str, baseline: str, history: Column
) -> DataFrame:
    """Predicted uplift: the median past share of the predicted sign by place in the month, times the baseline.

    ``df`` carries ``count_weeks`` and ``week_order``.
    """
    place = [*keys, "count_weeks", "week_order"]
    past = df.where(history & (F.col("count_weeks") >= 4)).groupBy(*place, sign).agg(
        F.percentile(share, 0.5).alias("median_share"))
    return df.join(past, [*place, sign], "left").withColumn(
        "predicted_uplift", F.coalesce("median_share", F.lit(0.0)) * F.col(baseline))


def collapse_lines(df: DataFrame, keys: Sequence[str], mechanic: Sequence[str], mean: str) -> DataFrame:
    """One line per mechanic (first start, last end), then one per timing (first mechanic by name)."""
    by_mechanic = df.groupBy(*keys, *mechanic).agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.avg(mean).alias(mean))
    first = F.min(F.struct(*mechanic))
    return by_mechanic.groupBy(*keys, "start_date", "end_date").agg(
        first.alias("_first"), F.avg(mean).alias(mean)
    ).select(*keys, "start_date", "end_date", "_first.*", mean)


def without_banded(sales: DataFrame, banded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales without the banded uplift; materials with a contribution outside ±2 are left out."""
    kept = banded.where(F.col("contribution").between(-2, 2))
    weekly = kept.groupBy(*keys).agg(
        F.sum(F.col("preload_volume") + F.col("postload_volume")).alias("uplift_banded"),
        F.count(F.lit(1)).alias("banded_count"))
    return sales.join(weekly, list(keys), "left").na.fill({"uplift_banded": 0.0, "banded_count": 0}).withColumn(
        "sales_without_banded", F.col("sales") - F.col("uplift_banded"))


def future_starts(df: DataFrame, day: date) -> DataFrame:
    """Products and starts of promotions that begin after a day."""
    return df.where(F.col("start_date") > F.lit(day)).select(*PRODUCT, "start_date").distinct()
