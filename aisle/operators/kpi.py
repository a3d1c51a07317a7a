"""Sell-out KPIs, segmentation, propensity, e-commerce and order-compliance reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.functions import weeks, windows as win
from aisle.functions.exprs import beside, ratio, tier
from aisle.operators.aggregates import distinct_values
from aisle.operators.joins import apply_migration, grid
from aisle.operators.ranking import ordered_columns


def master_dataset(
    sales: DataFrame, migration: DataFrame, outlets: DataFrame, products: DataFrame, sites: DataFrame,
    excluded: Sequence[str],
) -> DataFrame:
    """Sell-out lines with current outlet codes, channel, product and site attributes.

    The type filter and the column choice come before the first join. Lines of
    unknown outlets or products drop out; an unknown site keeps its line.
    """
    kept = sales.where(~F.col("status").isin(*excluded))
    moved = apply_migration(kept, migration, "outlet", "prev_outlet", "new_outlet")
    return (
        moved.join(products.select("product", "dp_name", "brand", "category"), "product")
        .join(outlets.select("outlet", "channel"), "outlet")
        .join(sites.select("site", "region", "distributor"), "site", "left")
    )


def _between(day: str, start: date, end: date) -> Column:
    return F.col(day).between(F.lit(start), F.lit(end))


def mean_performance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales, active outlets, assortment and their per-site ratios of a peer group."""
    grouped = df.groupBy(*keys).agg(
        F.sum("gsv").alias("gsv"), F.count_distinct("outlet").alias("eco"),
        F.count_distinct("dp_name").alias("assortment"), F.count_distinct("site").alias("sites"))
    return grouped.select(
        *keys, "gsv", ratio("gsv", "assortment").alias("gsv_per_assortment"), ratio("eco", "sites").alias("eco_per_site"),
        ratio("assortment", "sites").alias("assortment_per_site"))


def site_performance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sales, active outlets and assortment of a site."""
    grouped = df.groupBy("site", *keys).agg(
        F.sum("gsv").alias("indi_gsv"), F.count_distinct("outlet").alias("indi_eco"),
        F.count_distinct("dp_name").alias("indi_assortment"))
    return grouped.withColumn("indi_gsv_per_assortment", ratio("indi_gsv", "indi_assortment"))


def month_to_date(df: DataFrame, day: str, run_date: date) -> DataFrame:
    return df.where(_between(day, run_date.replace(day=1), run_date))


def both_months(df: DataFrame, day: str, run_date: date) -> DataFrame:
    """Rows of the month to date (``_now`` true) and of the same days a year earlier (false)."""
    run = F.add_months(F.lit(run_date), -12)
    now = _between(day, run_date.replace(day=1), run_date)
    return df.where(now | F.col(day).between(F.trunc(run, "month"), run)).withColumn("_now", now)


def growth_of(df: DataFrame, performance: Callable[[DataFrame, Sequence[str]], DataFrame], keys: Sequence[str], measure: str,
              name: str, digits: int) -> DataFrame:
    """Performance of this month with sales of a year before (``gsv_ly``) and growth, of keys that sold in both.

    ``df`` comes from ``both_months``; sales are rounded to ``digits``.
    """
    before = df.where("NOT _now").groupBy(*keys).agg(F.round(F.sum("gsv"), digits).alias("gsv_ly"))
    current = performance(df.where("_now"), keys)
    return growth(current.withColumn(measure, F.round(measure, digits)), before, keys, measure, name)


def growth(current: DataFrame, before: DataFrame, keys: Sequence[str], measure: str, name: str) -> DataFrame:
    return current.join(before, list(keys)).withColumn(name, ratio(measure, "gsv_ly") - 1)


COMPONENTS = {
    "eco": ("indi_eco", "eco_per_site"),
    "assortment": ("indi_assortment", "assortment_per_site"),
    "gsv_per_assortment": ("indi_gsv_per_assortment", "gsv_per_assortment"),
}


def compare_with_peers(site: DataFrame, peers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Site growth against its peers, gaps of the scaled components and the order to work on them.

    Every component is scaled to 0–1 over the whole report; the extremes come
    from one aggregate row.
    """
    joined = site.join(peers, list(keys))
    columns = [c for pair in COMPONENTS.values() for c in pair]
    spans = joined.agg(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(f"_{c}") for c in columns])
    scaled = beside(joined, spans).select(*joined.columns, *[
        ratio(F.col(c).cast("double") - F.col(f"_{c}.low"), F.col(f"_{c}.high") - F.col(f"_{c}.low")).alias(f"{c}_scaled")
        for c in columns])
    gaps = scaled.select("*", *[
        (ratio(f"{own}_scaled", f"{peer}_scaled") - 1).alias(f"gap_{name}") for name, (own, peer) in COMPONENTS.items()])
    names = [f"gap_{name}" for name in COMPONENTS]
    better = F.when(F.col("indi_growth") > F.col("mean_growth"), "better").otherwise("worse")
    return gaps.select("*", better.alias("is_growth_better"), ordered_columns(names).alias("focus_order"))


def outlet_tiers(
    df: DataFrame, day: str, run_date: date, steps: Sequence[tuple[float, str]], rest: str
) -> DataFrame:
    """Outlets active last month at a site, with the tier of their three-month average.

    One scan gives both sums.
    """
    first = F.trunc(F.lit(run_date), "month")
    month = F.col(day).between(F.add_months(first, -1), F.date_sub(first, 1))
    last = F.date_sub(F.lit(run_date), 1)
    quarter = F.col(day).between(F.add_months(last, -3), last)
    sums = df.where(month | quarter).groupBy("outlet", "site").agg(
        F.sum(F.when(month, F.col("gsv"))).alias("gsv"), (F.sum(F.when(quarter, F.col("gsv"))) / 3).alias("avg_gsv_l3m"))
    both = sums.where("gsv is not null and avg_gsv_l3m is not null")
    return both.withColumn("outlet_type", tier("avg_gsv_l3m", steps, rest))


def site_profile(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Coverage and sales share of every outlet type at every site, as one row per site."""
    keys = df.select("site").distinct()
    cells = df.groupBy("site", "outlet_type").agg(
        F.sum("gsv").alias("gsv"), F.count_if(F.col("gsv") > 0).alias("eco"), F.count_distinct("outlet").alias("outlets"))
    full = grid(keys, F.array(*map(F.lit, types)), "outlet_type").join(
        cells, ["site", "outlet_type"], "left").na.fill(0)
    wide = full.groupBy("site").agg(
        F.sum("gsv").alias("total_gsv"), F.sum("eco").alias("total_eco"), F.sum("outlets").alias("_outlets"),
        *[F.sum(F.when(F.col("outlet_type") == k, F.col(c))).alias(f"_{c}_{i}")
          for i, k in enumerate(types, 1) for c in ("outlets", "gsv")])
    return wide.where("total_gsv != 0").select(
        "site", "total_gsv", "total_eco",
        *[ratio(f"_outlets_{i}", "_outlets").alias(f"coverage_{i}") for i in range(1, len(types) + 1)],
        *[ratio(f"_gsv_{i}", "total_gsv").alias(f"gsv_share_{i}") for i in range(1, len(types) + 1)])


def next_week_labels(df: DataFrame, keys: Sequence[str], day: str, run_date: date, reach: int = 4) -> DataFrame:
    """Did a key buy in each of the weeks after the run date; one conditional aggregate."""
    week = F.floor((F.datediff(day, F.lit(run_date)) - 1) / 7) + 1
    ahead = df.where((F.col(day) > F.lit(run_date)) & (F.datediff(day, F.lit(run_date)) <= 7 * reach))
    return ahead.groupBy(*keys).agg(*[
        F.max((week == i).cast("int")).alias(f"buy_next_{i}w") for i in range(1, reach + 1)])


def rfm_features(df: DataFrame, keys: Sequence[str], day: str, run_date: date) -> DataFrame:
    """Recency, frequency and value features as of a run date.

    Own definitions: sums and bill counts over the last week and the last six
    months, mean order value, days since the last purchase (at most one year
    back), days since the first purchase, and months with a bill.
    """
    run = F.lit(run_date)
    week = F.col(day) > F.date_sub(run, 7)
    half = F.col(day) > F.add_months(run, -6)
    past = df.where(F.col(day) <= run)
    bills = past.groupBy(*keys, "invoice", day).agg(F.sum("gsv").alias("_value"))
    out = bills.groupBy(*keys).agg(
        F.sum(F.when(week, F.col("_value")).otherwise(0.0)).alias("gsv_l1w"),
        F.sum(F.when(half, F.col("_value")).otherwise(0.0)).alias("gsv_l6m"),
        F.count_if(week).alias("bills_l1w"), F.count_if(half).alias("bills_l6m"),
        F.avg(F.when(half, F.col("_value"))).alias("order_value_l6m"),
        F.datediff(run, F.max(day)).alias("_recency"), F.datediff(run, F.min(day)).alias("lifetime"),
        F.count_distinct(F.trunc(day, "month")).alias("months_with_bill"))
    return out.withColumn("recency", F.when(F.col("_recency") <= 365, F.col("_recency"))).drop("_recency")


def monthly_hits(
    df: DataFrame, keys: Sequence[str], labels: Sequence[str], predictions: Sequence[str], value: str
) -> DataFrame:
    """Any-of-month label and prediction, whether they agree, and the value share of the agreement by key."""
    bought = F.greatest(*[F.col(c) for c in labels]) > 0
    foreseen = F.greatest(*[F.col(c) for c in predictions]) > 0
    grouped = df.groupBy(*keys, (bought == foreseen).alias("is_correct")).agg(
        F.count(F.lit(1)).alias("members"), F.sum(value).alias("value"))
    whole = F.sum("value").over(Window.partitionBy(*keys))
    return grouped.withColumn("value_share", ratio("value", whole))


def period_report(df: DataFrame, day: str, run_date: date) -> DataFrame:
    """Shop report over the eight reporting periods from one scan.

    A line is booked on every period its date falls in; periods are literals, so
    nothing is joined.
    """
    done = F.col("status") != "P"
    booked = df.where(F.col(day) >= F.date_sub(F.lit(run_date), 70)).select(
        "*", F.explode(weeks.periods_of(day, run_date)).alias("_p"))
    return booked.groupBy(F.col("_p.period").alias("period")).agg(
        F.sum("gsv").alias("gmv"), F.sum(F.when(done, F.col("gsv")).otherwise(0.0)).alias("nmv"),
        F.count_distinct("invoice").alias("gross_orders"),
        F.count_distinct(F.when(done, F.col("invoice"))).alias("net_orders"),
        F.sum("qty").alias("gross_items"), F.sum(F.when(done, F.col("qty")).otherwise(0.0)).alias("net_items"))


def daily_performance(orders: DataFrame, traffic: DataFrame, sites: DataFrame) -> DataFrame:
    """Orders of a shop and day with its traffic and region; both sides are aggregated before the join."""
    done = F.col("status") != "P"
    daily = orders.groupBy("date", "site").agg(
        F.sum("gsv").alias("gmv"), F.sum(F.when(done, F.col("gsv")).otherwise(0.0)).alias("nmv"),
        F.count_distinct("invoice").alias("gross_orders"), F.sum("qty").alias("gross_items"))
    return daily.join(traffic, ["date", "site"], "left").join(sites.select("site", "region"), "site", "left").select(
        "date", "site", "region", "gmv", "nmv", "gross_orders", "gross_items", "visitors", "views", "buyers",
        ratio("gross_orders", "visitors").alias("conversion"), ratio("gmv", "buyers").alias("gmv_per_buyer"))


def inventory_report(stock: DataFrame, item: str, start: date, end: date, limit: int = 60) -> DataFrame:
    """Stock of every item and day, carried forward at most ``limit`` days; days without a known stock drop out."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    inside = stock.where(_between("date", start, end))
    full = grid(inside.select(item).distinct(), days, "date").join(inside, [item, "date"], "left")
    spec = win.series([item], "date")
    return full.select(item, "date", win.forward_fill("stock", spec, limit).alias("stock")).where("stock is not null")


def compliance_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Order compliance 1 − |confirmed − proposed| / proposed, two digits."""
    sums = df.groupBy(*keys).agg(F.sum("proposed").alias("proposed"), F.sum("confirmed").alias("confirmed"))
    gap = F.abs(F.col("confirmed") - F.col("proposed"))
    return sums.withColumn("compliance_rate", F.round(1 - ratio(gap, "proposed"), 2))


def manual_rate(df: DataFrame, keys: Sequence[str], kind: str, manual: Sequence[str]) -> DataFrame:
    """Order quantity per type of the data as numbered columns, and the share of the manual types in the whole quantity."""
    wide = df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(kind).eqNullSafe(F.lit(k)), F.col("qty")).otherwise(0.0)).alias(f"qty_{i}")
          for i, k in enumerate(distinct_values(df, kind), 1)],
        F.sum("qty").alias("_total"), F.sum(F.when(F.col(kind).isin(*manual), F.col("qty")).otherwise(0.0)).alias("_manual"))
    return wide.withColumn("manual_rate", F.round(ratio("_manual", "_total"), 4)).drop("_total", "_manual")


def customer_value(
    orders: DataFrame, customer: str, day: str, value: str, order: str, cut: date, buckets: Sequence[date]
) -> DataFrame:
    """Customer statistics before a cut, value per three-month bucket, and the value after the cut as target.

    Lines are brought to orders first; everything else is one aggregate per customer.
    """
    bills = orders.groupBy(customer, order, day).agg(F.sum(value).alias("_v"))
    before = F.col(day) < F.lit(cut)
    v = F.when(before, F.col("_v"))
    parts = [
        F.sum(F.when((F.col(day) >= F.lit(b)) & (F.col(day) < F.add_months(F.lit(b), 3)), F.col("_v")).otherwise(0.0))
        .alias(f"bucket_{i}") for i, b in enumerate(buckets, 1)
    ]
    out = bills.groupBy(customer).agg(
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("highest"), F.count(v).alias("orders"),
        F.datediff(F.max(F.when(before, F.col(day))), F.min(F.when(before, F.col(day)))).alias("span"), *parts,
        F.sum(F.when(before, 0.0).otherwise(F.col("_v"))).alias("target"))
    return out.where("orders > 0")


def distinct_share(df: DataFrame, key: str, item: str) -> DataFrame:
    """Distinct items per key and their share of the sum over keys."""
    counted = df.groupBy(key).agg(F.count_distinct(item).alias("items"))
    total = counted.agg(F.sum("items").alias("_total"))
    return beside(counted, total).select(key, "items", ratio("items", "_total").alias("share"))
