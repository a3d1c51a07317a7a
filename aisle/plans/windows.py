"""Queries: window functions on aggregated series."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aisle.functions import weeks, windows as win
from aisle.operators import joins, ordering, windows as ops
from aisle.plans.registry import query

KEYS = ["brand", "region"]
_SERIES = "PARTITION BY brand, region ORDER BY week_no"


@query("win01_row_number_dedupe", """
SELECT p_name, p_brand, p_partkey, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) x
WHERE rn = 1
""")
def row_number_dedupe(t):
    parts = t.part.select("p_name", "p_brand", "p_partkey", "p_retailprice")
    return joins.dedupe(parts, ["p_name", "p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")])


@query("win02_latest_row", """
SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS last_order,
       arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey,
       arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS o_orderstatus
FROM orders GROUP BY o_custkey
""")
def latest_row(t):
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("newest")
    return t.orders.groupBy("o_custkey").agg(newest).select(
        "o_custkey", F.to_date("newest.o_orderdate").alias("last_order"), "newest.o_orderkey", "newest.o_orderstatus")


@query("win03_lag_ladder", f"""
SELECT brand, region, yearweek, qty, lag(qty, 1) OVER w AS qty_lag_1, lag(qty, 2) OVER w AS qty_lag_2,
       lag(qty, 4) OVER w AS qty_lag_4, lag(qty, 13) OVER w AS qty_lag_13, lag(qty, 26) OVER w AS qty_lag_26,
       lag(qty, 52) OVER w AS qty_lag_52
FROM v_weekly WINDOW w AS ({_SERIES})
""")
def lag_ladder(t):
    spec = win.series(KEYS, "week_no")
    return t.weekly.select(*KEYS, "yearweek", "qty", *win.lags("qty", spec, [1, 2, 4, 13, 26, 52]))


def _range_sql(pairs):
    out = []
    for lag, roll in pairs:
        frame = f"OVER ({_SERIES} RANGE BETWEEN {lag + roll} PRECEDING AND {lag + 1} PRECEDING)"
        for stat, fn in (("sum", "sum(qty)"), ("mean", "avg(qty)"), ("median", "quantile_cont(qty, 0.5)"),
                         ("max", "max(qty)")):
            out.append(f"{fn} {frame} AS qty_lag_{lag}_roll_{roll}_{stat}")
    return ", ".join(out)


_PAIRS = [(1, 4), (4, 4), (4, 13)]


@query("win04_rolling_range", f"SELECT brand, region, yearweek, {_range_sql(_PAIRS)} FROM v_weekly")
def rolling_range(t):
    spec = win.series(KEYS, "week_no")
    return t.weekly.select(*KEYS, "yearweek", *win.rolling_range("qty", spec, _PAIRS))


def _rows_sql(pairs):
    out = []
    for lag, n in pairs:
        frame = f"OVER ({_SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for stat, fn in (("mean", "avg({})"), ("median", "quantile_cont({}, 0.5)"), ("max", "max({})"),
                         ("min", "min({})")):
            out.append(f"{fn.format(f'qty_lag_{lag}')} {frame} AS qty_lag_{lag}_rolling_{stat}_{n}")
    return ", ".join(out)


_ROWS = [(2, 4), (4, 4), (2, 8)]


@query("win05_lag_rolling_rows", f"""
SELECT brand, region, week_no, qty, qty_lag_2, qty_lag_4, {_rows_sql(_ROWS)}
FROM (SELECT *, lag(qty, 2) OVER w AS qty_lag_2, lag(qty, 4) OVER w AS qty_lag_4
      FROM v_weekly WINDOW w AS ({_SERIES})) x
""")
def lag_rolling_rows(t):
    base = t.weekly.select(*KEYS, "week_no", "qty")
    return ops.lag_rolling_rows(base, KEYS, "week_no", "qty", _ROWS)


@query("win06_rolling_count", f"""
SELECT brand, region, week_no, return_qty,
       CAST(sum(h2) OVER ({_SERIES} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS count_0_lag_2_rolling_4,
       CAST(sum(h4) OVER ({_SERIES} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS BIGINT) AS count_0_lag_4_rolling_8
FROM (SELECT *, CASE WHEN lag(return_qty, 2) OVER ({_SERIES}) = 0 THEN 1 ELSE 0 END AS h2,
             CASE WHEN lag(return_qty, 4) OVER ({_SERIES}) = 0 THEN 1 ELSE 0 END AS h4 FROM v_weekly) x
""")
def rolling_count(t):
    base = t.weekly.select(*KEYS, "week_no", "return_qty")
    return ops.rolling_count_equal(base, KEYS, "week_no", "return_qty", 0, [(2, 4), (4, 8)])


def _daily_frame(n):
    return (f"OVER (PARTITION BY brand ORDER BY date RANGE BETWEEN INTERVAL {n} DAY PRECEDING "
            "AND INTERVAL 1 DAY PRECEDING)")


_SPANS = [1, 7, 30, 180, 365]
_STATS = [("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max")]


@query("win07_trailing_stats", "SELECT brand, date, " + ", ".join(
    f"{fn}(qty) {_daily_frame(n)} AS qty_last_{n}_{s}" for n in _SPANS for s, fn in _STATS) + " FROM v_daily")
def trailing_stats(t):
    daily = t.daily.withColumn("day_no", F.unix_date("date"))
    spec = win.series(["brand"], "day_no")
    return daily.select("brand", "date", *win.trailing_range("qty", spec, _SPANS, [s for s, _ in _STATS]))


@query("win08_expanding_stats", """
SELECT brand, date, sum(qty) OVER w AS qty_before_sum, avg(qty) OVER w AS qty_before_mean,
       max(qty) OVER w AS qty_before_max, count(*) FILTER (WHERE qty > 0) OVER w AS qty_before_positive
FROM v_daily WINDOW w AS (PARTITION BY brand ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING
                          AND INTERVAL 1 DAY PRECEDING)
""")
def expanding_stats(t):
    spec = win.series(["brand"], "day_no")
    return t.daily.withColumn("day_no", F.unix_date("date")).select(
        "brand", "date", *win.expanding("qty", spec, ["sum", "mean", "max"]))


@query("win09_trailing_promotions", f"""
SELECT brand, region, week_no, CAST(sum(promo) OVER a AS BIGINT) AS promo_weeks_13,
       CAST(sum(promo) OVER b AS BIGINT) AS promo_weeks_52, max(intensity) OVER a AS intensity_max_13,
       round(avg(intensity) OVER a, 9) AS intensity_mean_13
FROM (SELECT *, CASE WHEN promo_qty > 0 THEN 1 ELSE 0 END AS promo, promo_qty / qty AS intensity FROM v_weekly) x
WINDOW a AS ({_SERIES} RANGE BETWEEN 13 PRECEDING AND 1 PRECEDING),
       b AS ({_SERIES} RANGE BETWEEN 52 PRECEDING AND 1 PRECEDING)
""")
def trailing_promotions(t):
    base = t.weekly.select(
        *KEYS, "week_no", F.when(F.col("promo_qty") > 0, 1).otherwise(0).alias("promo"),
        (F.col("promo_qty") / F.col("qty")).alias("intensity"))
    spec = win.series(KEYS, "week_no")
    short, long = spec.rangeBetween(-13, -1), spec.rangeBetween(-52, -1)
    return base.select(
        *KEYS, "week_no", F.sum("promo").over(short).alias("promo_weeks_13"),
        F.sum("promo").over(long).alias("promo_weeks_52"), F.max("intensity").over(short).alias("intensity_max_13"),
        F.round(F.avg("intensity").over(short), 9).alias("intensity_mean_13"))


@query("win10_feature_grid", f"""
SELECT brand, region, week_no, qty, lines,
       sum(qty) OVER a4 AS brand_region_qty_4_sum, max(qty) OVER a4 AS brand_region_qty_4_max,
       sum(qty) OVER a13 AS brand_region_qty_13_sum, max(qty) OVER a13 AS brand_region_qty_13_max,
       CAST(sum(lines) OVER b8 AS BIGINT) AS brand_lines_8_sum
FROM v_weekly
WINDOW a4 AS ({_SERIES} RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING),
       a13 AS ({_SERIES} RANGE BETWEEN 13 PRECEDING AND 1 PRECEDING),
       b8 AS (PARTITION BY brand ORDER BY week_no RANGE BETWEEN 9 PRECEDING AND 2 PRECEDING)
""")
def feature_grid(t):
    specs = [
        ops.FeatureSpec("qty", ("brand", "region"), (4, 13), ("sum", "max")),
        ops.FeatureSpec("lines", ("brand",), (8,), ("sum",), lag=2),
    ]
    return ops.feature_grid(t.weekly.select(*KEYS, "week_no", "qty", "lines"), "week_no", specs)


@query("win11_diversity", """
SELECT site, week_no, CAST(count(DISTINCT brand) FILTER (WHERE s BETWEEN week_no - 4 AND week_no - 1) AS BIGINT)
       AS brand_last_4,
       CAST(count(DISTINCT brand) FILTER (WHERE s BETWEEN week_no - 13 AND week_no - 1) AS BIGINT) AS brand_last_13
FROM (SELECT a.site, a.week_no, b.week_no AS s, b.brand
      FROM (SELECT DISTINCT site, date_diff('day', DATE '1970-01-05', date) // 7 AS week_no FROM v_lines) a
      LEFT JOIN (SELECT DISTINCT x.site, date_diff('day', DATE '1970-01-05', x.date) // 7 AS week_no, p.brand
                 FROM v_lines x JOIN v_products p ON x.product = p.product) b
      ON a.site = b.site AND b.week_no BETWEEN a.week_no - 13 AND a.week_no - 1) z
GROUP BY site, week_no
""".replace("SELECT site, week_no, CAST(count", "SELECT site, CAST(week_no AS INTEGER) AS week_no, CAST(count"))
def diversity(t):
    lines = t.primary_lines.join(t.products.select("product", "brand"), "product").select(
        "site", "brand", weeks.week_index("date").alias("week_no"))
    return ops.diversity(t.dealt(lines, "site", "brand"), ["site"], "week_no", "brand", [4, 13])


@query("win12_calendar_neighbors", """
WITH c AS (SELECT week, CAST(6 - working_days AS INTEGER) AS holiday_days FROM v_weeks),
n AS (SELECT week, holiday_days, coalesce(lag(holiday_days) OVER (ORDER BY week), 0) AS holiday_last_week,
             coalesce(lead(holiday_days) OVER (ORDER BY week), 0) AS holiday_next_week FROM c)
SELECT w.brand, w.region, w.yearweek, w.qty, n.holiday_days, n.holiday_last_week, n.holiday_next_week
FROM v_weekly w JOIN n ON w.week = n.week
""")
def calendar_neighbors(t):
    spec = Window.orderBy("week")
    holidays = (F.lit(6) - F.col("working_days")).alias("holiday_days")
    calendar = weeks.week_calendar(t.spark, *t.span).select("week", holidays).select(
        "*", F.coalesce(F.lag("holiday_days").over(spec), F.lit(0)).alias("holiday_last_week"),
        F.coalesce(F.lead("holiday_days").over(spec), F.lit(0)).alias("holiday_next_week"))
    return t.weekly.select(*KEYS, "week", "yearweek", "qty").join(calendar, "week").drop("week")


@query("win13_week_order", """
SELECT w.brand, w.region, w.week, w.qty, c.order_in_month, c.order_in_quarter, c.weeks_in_month
FROM v_weekly w JOIN (
  SELECT week, CAST(row_number() OVER (PARTITION BY year(week), month(week) ORDER BY week) AS INTEGER) AS order_in_month,
         CAST(row_number() OVER (PARTITION BY year(week), quarter(week) ORDER BY week) AS INTEGER) AS order_in_quarter,
         count(*) OVER (PARTITION BY year(week), month(week)) AS weeks_in_month FROM v_weeks) c ON w.week = c.week
""")
def week_order(t):
    month = Window.partitionBy(F.trunc("week", "month"))
    quarter = Window.partitionBy(F.trunc("week", "quarter"))
    calendar = weeks.week_calendar(t.spark, *t.span).select(
        "week", F.row_number().over(month.orderBy("week")).alias("order_in_month"),
        F.row_number().over(quarter.orderBy("week")).alias("order_in_quarter"),
        F.count("week").over(month).alias("weeks_in_month"))
    return t.weekly.select(*KEYS, "week", "qty").join(calendar, "week")


@query("win14_high_low", """
SELECT o_orderpriority, o_orderkey, o_totalprice,
       CASE WHEN percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 0.3
            THEN 'High' ELSE 'Low' END AS level
FROM orders
""")
def high_low(t):
    orders = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ops.high_low(orders, ["o_orderpriority"], "o_totalprice", 0.3, "level")


@query("win15_abc_class", """
SELECT product, qty, round(upto / total, 9) AS cumulative_share,
       CASE WHEN upto / total <= 0.8 THEN 'A' WHEN upto / total <= 0.95 THEN 'B' ELSE 'C' END AS abc_class
FROM (SELECT product, qty, sum(qty) OVER () AS total,
             sum(qty) OVER (ORDER BY qty DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM (SELECT product, sum(qty) AS qty FROM v_lines GROUP BY product) g) x
""")
def abc_class(t):
    totals = t.primary_lines.groupBy("product").agg(F.sum("qty").alias("qty"))
    classes = ordering.abc_classes(totals, "product", "qty")
    return classes.withColumn("cumulative_share", F.round("cumulative_share", 9))


@query("win16_time_index", """
SELECT brand, region, yearweek, qty, CAST(dense_rank() OVER (ORDER BY yearweek) AS INTEGER) AS time_index FROM v_weekly
""")
def time_index(t):
    # The index is ranked on the distinct weeks, of which there are as many as the calendar has.
    known = t.weekly.select("yearweek").distinct()
    index = known.select("yearweek", F.dense_rank().over(Window.orderBy("yearweek")).alias("time_index"))
    return t.weekly.select(*KEYS, "yearweek", "qty").join(index, "yearweek")


_FILL_SQL = """
WITH g AS (SELECT k.brand, k.region, w.week_no, x.qty
           FROM (SELECT DISTINCT brand, region FROM v_weekly) k CROSS JOIN v_weeks w
           LEFT JOIN v_weekly x ON x.brand = k.brand AND x.region = k.region AND x.week_no = w.week_no)
"""


def _sparse(t):
    full = joins.grid(t.weekly.select(*KEYS).distinct(), t.mondays, "week")
    return full.select(*KEYS, weeks.week_index("week").alias("week_no")).join(
        t.weekly.select(*KEYS, "week_no", "qty"), [*KEYS, "week_no"], "left")


@query("win17_forward_fill_limit", _FILL_SQL + f"""
SELECT brand, region, week_no, last_value(qty IGNORE NULLS) OVER
       ({_SERIES} ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS qty
FROM g
""")
def forward_fill_limit(t):
    spec = win.series(KEYS, "week_no")
    return _sparse(t).select(*KEYS, "week_no", win.forward_fill("qty", spec, 60).alias("qty"))


@query("win18_fill_both_ways", _FILL_SQL + f"""
SELECT brand, region, week_no,
       last_value(qty IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty_ffill,
       first_value(qty IGNORE NULLS) OVER ({_SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qty_bfill
FROM g
""")
def fill_both_ways(t):
    spec = win.series(KEYS, "week_no")
    return _sparse(t).select(
        *KEYS, "week_no", win.forward_fill("qty", spec).alias("qty_ffill"),
        win.backward_fill("qty", spec).alias("qty_bfill"))


@query("win19_cumulative_share", f"""
SELECT brand, region, yearweek, qty,
       sum(qty) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
       sum(qty) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       / sum(qty) OVER (PARTITION BY brand, region) AS running_share
FROM v_weekly
""")
def cumulative_share(t):
    base = t.weekly.select(*KEYS, "week_no", "yearweek", "qty")
    return ops.cumulative_share(base, KEYS, "week_no", "qty").drop("week_no")


@query("win20_ratio_to_total", """
SELECT brand, region, yearweek, qty / sum(qty) OVER (PARTITION BY brand, yearweek) AS region_share FROM v_weekly
""")
def ratio_to_total(t):
    return t.weekly.select(*KEYS, "yearweek", ops.ratio_to_total("qty", ["brand", "yearweek"]).alias("region_share"))


@query("win21_group_broadcast", """
SELECT brand, region, yearweek, qty, max(promo_qty) OVER (PARTITION BY brand, yearweek) AS promo_nationwide,
       min(qty) OVER (PARTITION BY brand, region) AS qty_low, max(qty) OVER (PARTITION BY brand, region) AS qty_high
FROM v_weekly
""")
def group_broadcast(t):
    national, series = Window.partitionBy("brand", "yearweek"), Window.partitionBy(*KEYS)
    return t.weekly.select(
        *KEYS, "yearweek", "qty", F.max("promo_qty").over(national).alias("promo_nationwide"),
        F.min("qty").over(series).alias("qty_low"), F.max("qty").over(series).alias("qty_high"))


@query("win22_capped_trend", f"""
SELECT brand, region, week_no, qty, round(trend_pct, 6) AS trend_pct,
       round(avg(trend_pct) OVER (PARTITION BY brand, region), 6) AS mean_trend_pct
FROM (SELECT *, CASE WHEN prev IS NULL OR prev = 0 THEN NULL
                     ELSE least(greatest((qty - prev) / prev * 100, -100), 100) END AS trend_pct
      FROM (SELECT brand, region, week_no, qty, lag(qty) OVER ({_SERIES}) AS prev FROM v_weekly) a) b
""")
def capped_trend(t):
    out = ops.trend_stats(t.weekly.select(*KEYS, "week_no", "qty"), KEYS, "week_no", "qty")
    return out.withColumns({c: F.round(c, 6) for c in ("trend_pct", "mean_trend_pct")})


@query("win23_difference", f"""
SELECT brand, region, week_no, diff, first_value(qty) OVER w + sum(coalesce(diff, 0)) OVER w AS restored,
       round(ln(1 + qty), 9) AS log_qty, round(exp(ln(1 + qty)) - 1, 6) AS back
FROM (SELECT brand, region, week_no, qty, qty - lag(qty) OVER ({_SERIES}) AS diff FROM v_weekly) x
WINDOW w AS ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def difference(t):
    spec = win.series(KEYS, "week_no")
    diffed = t.weekly.select(*KEYS, "week_no", "qty", win.difference("qty", spec).alias("diff"))
    start = F.first("qty").over(spec.rowsBetween(Window.unboundedPreceding, 0))
    return diffed.select(
        *KEYS, "week_no", "diff",
        (start + win.running_sum(F.coalesce("diff", F.lit(0.0)), spec)).alias("restored"),
        F.round(F.log1p("qty"), 9).alias("log_qty"), F.round(F.expm1(F.log1p("qty")), 6).alias("back"))


@query("win24_promo_runs", f"""
SELECT brand, region, week_no, promo_qty,
       CAST(sum(opens) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_no
FROM (SELECT *, CASE WHEN coalesce(week_no - lag(week_no) OVER ({_SERIES}), 0) > 2 OR
                coalesce(sum(promo_qty) OVER ({_SERIES} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 0
                THEN 1 ELSE 0 END AS opens FROM v_weekly) x
""")
def promo_runs(t):
    return ops.promo_runs(t.weekly.select(*KEYS, "week_no", "promo_qty"), KEYS, "week_no", "promo_qty")


@query("win25_cap_per_label", """
SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('0|' || o_orderkey), o_orderkey) <= 100
""")
def cap_per_label(t):
    lines = t.orders.select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return ops.cap_per_label(lines, ["o_orderstatus", "o_orderpriority"], 100, ["o_orderkey"])


@query("win26_next_event_distance", """
SELECT product, scheme, start_date, end_date, CAST(greatest(coalesce(
       date_diff('day', end_date, lead(start_date) OVER (PARTITION BY product ORDER BY start_date, scheme)), 0), 0)
       AS INTEGER) AS days_to_next
FROM v_promotions
""")
def next_event_distance(t):
    posts = t.promotions.select("product", "scheme", "start_date", "end_date")
    return ops.next_event_distance(posts, ["product"], "scheme", "start_date", "end_date", "days_to_next")


@query("win27_carry_over", f"""
SELECT brand, region, week_no, CAST(coalesce(2 * lag(key_event) OVER w, 0) + coalesce(lag(special) OVER w, 0) AS INTEGER)
       AS carry_over
FROM (SELECT *, CASE WHEN promo_qty >= 50 THEN 1 ELSE 0 END AS key_event,
             CASE WHEN return_qty >= 50 THEN 1 ELSE 0 END AS special FROM v_weekly) x
WINDOW w AS ({_SERIES})
""")
def carry_over(t):
    spec = win.series(KEYS, "week_no")
    marked = t.weekly.select(
        *KEYS, "week_no", F.when(F.col("promo_qty") >= 50, 1).otherwise(0).alias("key_event"),
        F.when(F.col("return_qty") >= 50, 1).otherwise(0).alias("special"))
    before = lambda c: F.coalesce(F.lag(c).over(spec), F.lit(0))
    return marked.select(*KEYS, "week_no", (2 * before("key_event") + before("special")).alias("carry_over"))


_UPLIFT_SQL = f"(SELECT *, qty - avg(qty) OVER (PARTITION BY brand, region) AS uplift FROM v_weekly)"


def _uplift(t):
    return t.weekly.withColumn("uplift", F.col("qty") - F.avg("qty").over(Window.partitionBy(*KEYS)))


@query("win28_positive_runs", f"""
WITH s AS (SELECT brand, region, week_no, CASE WHEN uplift >= 0 AND nxt >= 0 THEN 1 ELSE 0 END AS step,
                  CASE WHEN uplift > 0 AND nxt < 0 THEN 1 ELSE 0 END AS turn
           FROM (SELECT *, lead(uplift) OVER ({_SERIES}) AS nxt FROM {_UPLIFT_SQL} u) x),
runs AS (SELECT *, coalesce(sum(turn) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
         FROM s),
lengths AS (SELECT brand, region, run, sum(step) AS len, max(turn) AS done FROM runs GROUP BY 1, 2, 3)
SELECT brand, region, CAST(sum(done) AS BIGINT) AS turns, round(avg(len) FILTER (WHERE done = 1), 9) AS mean_run
FROM lengths GROUP BY 1, 2
""")
def positive_runs(t):
    out = ops.positive_run_length(_uplift(t), KEYS, "week_no", "uplift")
    return out.withColumn("mean_run", F.round("mean_run", 9))


@query("win29_conditional_diff", f"""
SELECT brand, region, week_no, promo_qty - lag(promo_qty, 2) OVER ({_SERIES}) AS promo_qty_diff_2
FROM (SELECT *, sum(uplift) OVER ({_SERIES} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before,
             count(*) OVER ({_SERIES} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n FROM {_UPLIFT_SQL} u) x
WHERE uplift < 0 AND n >= 2 AND before >= 0
""")
def conditional_diff(t):
    return ops.conditional_diff(_uplift(t), KEYS, "week_no", "uplift", "promo_qty", 2)


@query("win30_quantile_bins", """
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS orders, round(sum(o_totalprice), 2) AS value
FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS bin FROM orders) x GROUP BY 1
""")
def quantile_bins(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    binned = ordering.equal_frequency_bins(orders, [F.col("o_totalprice"), F.col("o_orderkey")], 10)
    return binned.groupBy("bin").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))
