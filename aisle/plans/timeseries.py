"""Queries: time-series steps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window, functions as F

from aisle.functions import exprs, weeks
from aisle.operators import evaluation, timeseries as ts
from aisle.plans.registry import query

KEYS = ["brand", "region"]
CUT = date(2000, 12, 25)
_K = "PARTITION BY brand, region"
_S = "PARTITION BY brand, region ORDER BY week_no"


def _round(df, digits=6, *skip):
    doubles = [c for c, k in df.dtypes if k == "double" and c not in skip]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


@query("ts01_densify", """
SELECT k.brand, CAST(d AS DATE) AS date, coalesce(x.qty, 0) AS qty
FROM (SELECT brand, min(date) AS a, max(date) AS b FROM v_daily GROUP BY 1) k,
     unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) u(d)
LEFT JOIN v_daily x ON x.brand = k.brand AND x.date = CAST(d AS DATE)
""")
def densify(t):
    return ts.densify(t.daily.select("brand", "date", "qty"), ["brand"], "date", ["qty"])


@query("ts02_to_weekly", """
SELECT brand, CAST(year(date) * 100 + ceil(dayofyear(date) / 7.0) AS INTEGER) AS yearweek, sum(qty) AS qty,
       CAST(date_trunc('week', min(date)) AS DATE) + 3 AS anchor
FROM v_daily GROUP BY 1, 2
""")
def to_weekly(t):
    return ts.to_weekly(t.daily, ["brand"], "date", "qty")


_MART_SQL = """
WITH d AS (SELECT p.brand, {grain} AS period, sum(x.qty) AS qty, round(sum(x.gsv), 4) AS gsv
           FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY 1, 2),
b AS (SELECT p.brand, CAST(u.d AS DATE) AS date, x.scheme, x.discount FROM v_promotions x
      JOIN v_products p ON x.product = p.product,
      unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) u(d)),
m AS (SELECT brand, {grain_b} AS period, max(discount) AS best_discount, count(DISTINCT scheme) AS schemes
      FROM b GROUP BY 1, 2),
c AS (SELECT {grain_c} AS period, count(*) AS days FROM v_days WHERE dayofweek(date) <> 0 GROUP BY 1)
SELECT d.brand, d.period, d.qty, d.gsv, coalesce(m.best_discount, 0) AS best_discount, coalesce(m.schemes, 0) AS schemes,
       c.days
FROM d LEFT JOIN m ON d.brand = m.brand AND d.period = m.period LEFT JOIN c ON d.period = c.period
"""


def _half(d):
    return f"concat(strftime(date_trunc('week', {d}), '%Y-%m-%d'), CASE WHEN isodow({d}) <= 3 THEN '_1' ELSE '_2' END)"


def _mart(t, period):
    """Each side is brought to the grain on its own before the join, so nothing fans out."""
    lines = t.primary_lines.join(t.products.select("product", "brand"), "product")
    demand = lines.groupBy("brand", period("date").alias("period")).agg(
        F.sum("qty").alias("qty"), F.round(F.sum("gsv"), 4).alias("gsv"))
    days = t.promotions.join(t.products.select("product", "brand"), "product").select(
        "brand", "scheme", "discount",
        F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date"))
    promo = days.groupBy("brand", period("date").alias("period")).agg(
        F.max("discount").alias("best_discount"), F.count_distinct("scheme").alias("schemes"))
    calendar = weeks.day_frame(t.spark, *t.span).where(F.dayofweek("date") != 1)
    working = calendar.groupBy(period("date").alias("period")).agg(F.count("date").alias("days"))
    return demand.join(promo, ["brand", "period"], "left").join(working, "period", "left").na.fill(
        {"best_discount": 0.0, "schemes": 0})


@query("ts03_half_week_mart", _MART_SQL.format(grain=_half("x.date"), grain_b=_half("date"), grain_c=_half("date")))
def half_week_mart(t):
    return _mart(t, lambda d: F.concat(
        F.date_format(F.trunc(d, "week"), "yyyy-MM-dd"), F.when(weeks.half_week(d) == "first_half", "_1").otherwise("_2")))


@query("ts03_weekly_mart", _MART_SQL.format(
    grain="CAST(date_trunc('week', x.date) AS DATE)", grain_b="CAST(date_trunc('week', date) AS DATE)",
    grain_c="CAST(date_trunc('week', date) AS DATE)"))
def weekly_mart(t):
    return _mart(t, weeks.week_start)


@query("ts03_monthly_mart", _MART_SQL.format(
    grain="CAST(date_trunc('month', x.date) AS DATE)", grain_b="CAST(date_trunc('month', date) AS DATE)",
    grain_c="CAST(date_trunc('month', date) AS DATE)"))
def monthly_mart(t):
    return _mart(t, lambda d: F.trunc(d, "month"))


@query("ts04_daily_average", "SELECT brand, region, yearweek, working_days, daily FROM v_plan")
def daily_average(t):
    frame = t.plan.drop("daily")
    return frame.select(*KEYS, "yearweek", "working_days", ts.daily_average("qty", "working_days").alias("daily"))


@query("ts05_green_flag", """
SELECT brand, region, week, max(CAST(promo_qty > qty * 0.5::DOUBLE OR return_qty > qty * 0.9::DOUBLE AS INTEGER))
       OVER (PARTITION BY brand, week) AS green
FROM v_weekly
""")
def green_flag(t):
    own = (F.col("promo_qty") > F.col("qty") * 0.5) | (F.col("return_qty") > F.col("qty") * 0.9)
    return ts.green_flag(t.weekly, ["brand"], "week", own).select(*KEYS, "week", "green")


def _cap(c, mean, dev):
    return f"CASE WHEN {c} > {mean} + {dev} THEN {mean} + {dev} WHEN {c} < {mean} - {dev} THEN {mean} - {dev} ELSE {c} END"


_LAST13 = f"({_S} ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)"


@query("ts06_baseline_v1", f"""
WITH a AS (SELECT *, avg(daily) FILTER (WHERE green = 0) OVER ({_K}) AS m, stddev_samp(daily) FILTER (WHERE green = 0)
                  OVER ({_K}) AS s FROM v_plan),
b AS (SELECT brand, region, week_no, working_days, daily AS daily_original, {_cap('daily', 'm', 's')} AS daily FROM a),
c AS (SELECT *, count(*) OVER {_LAST13} >= 13 AS f, avg(daily) OVER {_LAST13} AS ma0,
             stddev_samp(daily) OVER {_LAST13} AS sd0, list(daily) OVER {_LAST13} AS l FROM b),
d AS (SELECT *, CASE WHEN f THEN ma0 END AS ma, CASE WHEN f THEN sd0 END AS mstd, CASE WHEN f THEN list_sort(l)[7] END AS mm
      FROM c),
e AS (SELECT *, CASE WHEN f THEN list_sort(list_transform(l, lambda x: abs(x - mm)))[7] END AS mmad FROM d)
SELECT brand, region, week_no, round(daily_original, 7) AS daily_original, round(daily, 7) AS daily, round(ma, 7) AS ma,
       round(mstd, 7) AS mstd, round(mm, 7) AS mm, round(mmad, 7) AS mmad, round(mm + 2 * mmad, 7) AS range_up_median,
       round(mm - 2 * mmad, 7) AS range_down_median, round({_cap('daily', 'ma', 'mstd')}, 7) AS baseline_daily,
       round(({_cap('daily', 'ma', 'mstd')}) * working_days, 7) AS baseline
FROM e
""")
def baseline_v1(t):
    out = ts.baseline_clean_v1(t.plan, KEYS, "week_no")
    return _round(out.select(
        *KEYS, "week_no", "daily_original", "daily", "ma", "mstd", "mm", "mmad", "range_up_median", "range_down_median",
        "baseline_daily", "baseline"), 7)


_LAST52 = f"({_S} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)"


@query("ts07_baseline_52w", f"""
WITH a AS (SELECT *, CASE WHEN count(*) OVER {_LAST52} >= 52 THEN avg(daily) FILTER (WHERE green = 0) OVER {_LAST52} END AS m,
                  CASE WHEN count(*) OVER {_LAST52} >= 52 THEN stddev_samp(daily) FILTER (WHERE green = 0)
                       OVER {_LAST52} END AS s FROM v_plan),
b AS (SELECT brand, region, week_no, working_days, m, s, {_cap('daily', 'm', 's')} AS daily FROM a),
c AS (SELECT *, CASE WHEN count(*) OVER {_LAST13} >= 13 THEN avg(daily) OVER {_LAST13} END AS ma,
             CASE WHEN count(*) OVER {_LAST13} >= 13 THEN stddev_samp(daily) OVER {_LAST13} END AS mstd FROM b)
SELECT brand, region, week_no, round(m, 7) AS ma_yellow, round(s, 7) AS mstd_yellow, round(daily, 7) AS daily,
       round(ma, 7) AS ma, round(mstd, 7) AS mstd, round({_cap('daily', 'ma', 'mstd')}, 7) AS baseline_daily,
       round(({_cap('daily', 'ma', 'mstd')}) * working_days, 7) AS baseline
FROM c
""")
def baseline_52w(t):
    out = ts.baseline_clean_52w(t.plan, KEYS, "week_no")
    return _round(out.select(
        *KEYS, "week_no", "ma_yellow", "mstd_yellow", "daily", "ma", "mstd", "baseline_daily", "baseline"), 7)


def _guard(fn, start, stop, rows, only=""):
    frame = f"({_S} ROWS BETWEEN {start} AND {stop})"
    return f"CASE WHEN count(*) OVER {frame} >= {rows} THEN {fn} {only} OVER {frame} END"


_Y = "FILTER (WHERE green = 0)"
_BASE_SQL = f"""
a AS (SELECT *, {_guard('avg(daily)', '25 PRECEDING', 'CURRENT ROW', 26, _Y)} AS lm,
             {_guard('avg(daily)', 'CURRENT ROW', '25 FOLLOWING', 26, _Y)} AS rm,
             {_guard('stddev_samp(daily)', '25 PRECEDING', 'CURRENT ROW', 26, _Y)} AS s FROM v_plan),
b AS (SELECT *, coalesce((lm + rm) / 2, lm, rm) AS m FROM a),
c AS (SELECT brand, region, week, week_no, working_days, daily AS daily_original, {_cap('daily', 'm', 's')} AS daily FROM b),
d AS (SELECT *, {_guard('avg(daily)', '6 PRECEDING', '1 PRECEDING', 6)} AS l1,
             {_guard('avg(daily)', '1 FOLLOWING', '6 FOLLOWING', 6)} AS r1,
             {_guard('stddev_samp(daily)', '6 PRECEDING', '1 PRECEDING', 6)} AS l2,
             {_guard('stddev_samp(daily)', '1 FOLLOWING', '6 FOLLOWING', 6)} AS r2 FROM c),
e AS (SELECT *, coalesce((l1 + r1) / 2, l1, r1) AS ma, coalesce((l2 + r2) / 2, l2, r2) AS mstd FROM d),
base AS (SELECT brand, region, week, week_no, daily_original, daily, ma, mstd, {_cap('daily', 'ma', 'mstd')} AS baseline_daily,
                ({_cap('daily', 'ma', 'mstd')}) * working_days AS baseline FROM e)
"""


@query("ts08_baseline_clean", f"""
WITH {_BASE_SQL}
SELECT brand, region, week_no, round(daily_original, 7) AS daily_original, round(daily, 7) AS daily, round(ma, 7) AS ma,
       round(mstd, 7) AS mstd, round(baseline_daily, 7) AS baseline_daily, round(baseline, 7) AS baseline
FROM base
""")
def baseline_clean(t):
    out = ts.baseline_clean(t.plan, KEYS, "week_no")
    return _round(out.select(*KEYS, "week_no", "daily_original", "daily", "ma", "mstd", "baseline_daily", "baseline"), 7)


_PLACED = """
p AS (SELECT *, CAST(date_trunc('month', anchor) AS DATE) AS month_start,
             count(*) OVER (PARTITION BY brand, region, date_trunc('month', anchor)) AS cw,
             row_number() OVER (PARTITION BY brand, region, date_trunc('month', anchor) ORDER BY week) AS wo FROM v_plan),
g AS (SELECT brand, region, cw, wo, avg(share) AS ratio_generic
      FROM (SELECT *, daily / nullif(sum(daily) OVER (PARTITION BY brand, region, month_start), 0) AS share
            FROM p WHERE week <= DATE '2000-12-25') h WHERE cw >= 4 GROUP BY 1, 2, 3, 4)
"""


@query("ts09_phasing_ratio", f"""
WITH {_PLACED}
SELECT p.brand, p.region, p.yearweek, CAST(p.cw AS INTEGER) AS count_weeks, CAST(p.wo AS INTEGER) AS week_order,
       round(g.ratio_generic, 9) AS ratio_generic
FROM p JOIN g ON p.brand = g.brand AND p.region = g.region AND p.cw = g.cw AND p.wo = g.wo
""")
def phasing_ratio(t):
    out = ts.phasing_ratio(t.plan, KEYS, "week", "anchor", "daily", F.col("week") <= F.lit(CUT))
    return out.select(*KEYS, "yearweek", "count_weeks", "week_order", F.round("ratio_generic", 9).alias("ratio_generic"))


_TREND_SQL = """
i AS (SELECT *, row_number() OVER (PARTITION BY brand, region ORDER BY week_no) AS x,
             week <= DATE '2000-12-25' AS hist FROM v_plan),
r AS (SELECT *, row_number() OVER (PARTITION BY brand, region, hist ORDER BY week_no DESC) AS back FROM i),
f AS (SELECT brand, region, regr_slope(daily, x) FILTER (WHERE hist) AS s1,
             regr_intercept(daily, x) FILTER (WHERE hist) AS i1,
             regr_slope(daily, x) FILTER (WHERE hist AND back <= 26) AS s2,
             regr_intercept(daily, x) FILTER (WHERE hist AND back <= 26) AS i2 FROM r GROUP BY 1, 2),
trend AS (SELECT i.brand, i.region, i.week, i.week_no, i.anchor, i.hist, i.daily, (s1 + 0.5 * s2) / 1.5 AS slope,
                 (i1 + 0.5 * i2) / 1.5 AS intercept, (i1 + 0.5 * i2) / 1.5 + (s1 + 0.5 * s2) / 1.5 * x AS trendline
          FROM i JOIN f ON i.brand = f.brand AND i.region = f.region)
"""


def _trend(t):
    return ts.trendline(t.plan, KEYS, "week_no", "daily", F.col("week") <= F.lit(CUT))


@query("ts10_trendline", f"""
WITH {_TREND_SQL}
SELECT brand, region, week_no, round(slope, 8) AS slope, round(intercept, 6) AS intercept, round(trendline, 6) AS trendline
FROM trend
""")
def trendline(t):
    return _trend(t).select(
        *KEYS, "week_no", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"),
        F.round("trendline", 6).alias("trendline"))


@query("ts11_trend_by_half", f"""
WITH i AS (SELECT *, row_number() OVER ({_S}) AS x,
                  CAST(year(anchor) * 2 + (month(anchor) - 1) // 6 AS INTEGER) AS half FROM v_plan),
f AS (SELECT brand, region, half, CASE WHEN count(*) >= 13 THEN regr_slope(daily, x) END AS s,
             CASE WHEN count(*) >= 13 THEN regr_intercept(daily, x) END AS c FROM i GROUP BY 1, 2, 3),
g AS (SELECT brand, region, half, coalesce(first_value(s IGNORE NULLS) OVER up, last_value(s IGNORE NULLS) OVER down) AS s,
             coalesce(first_value(c IGNORE NULLS) OVER up, last_value(c IGNORE NULLS) OVER down) AS c
      FROM f WINDOW up AS ({_K} ORDER BY half ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
                    down AS ({_K} ORDER BY half ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT i.brand, i.region, i.week_no, i.half, round(g.s, 8) AS slope, round((g.c + g.s * x) * working_days, 5) AS trendline
FROM i JOIN g ON i.brand = g.brand AND i.region = g.region AND i.half = g.half
""")
def trend_by_half(t):
    out = ts.trend_by_half(t.plan, KEYS, "week_no", "anchor", "daily")
    return out.select(*KEYS, "week_no", "half", F.round("slope", 8).alias("slope"),
                      F.round("trendline", 5).alias("trendline"))


@query("ts12_lifecycle_slopes", f"""
WITH i AS (SELECT brand, region, daily, row_number() OVER ({_S}) AS x, count(*) OVER ({_K}) AS n FROM v_plan),
c AS (SELECT *, n // 26 AS k FROM i WHERE n > 52),
j AS (SELECT *, CASE WHEN x - 1 < (n % k) * (n // k + 1) THEN (x - 1) // (n // k + 1)
                ELSE n % k + (x - 1 - (n % k) * (n // k + 1)) // (n // k) END AS chunk FROM c)
SELECT brand, region, CAST(chunk AS INTEGER) AS chunk, count(*) AS rows, round(regr_slope(daily, x), 8) AS slope,
       round(regr_intercept(daily, x), 6) AS intercept
FROM j GROUP BY 1, 2, 3 HAVING count(*) > 13
""")
def lifecycle_slopes(t):
    out = ts.lifecycle_slopes(t.plan, KEYS, "week_no", "daily")
    return out.withColumns({"slope": F.round("slope", 8), "intercept": F.round("intercept", 6)})


_CUMSUM_SQL = f"""
cs AS (SELECT *, row_number() OVER ({_S}) AS x, week <= DATE '2000-12-25' AS hist,
              sum(daily) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM v_plan),
cf AS (SELECT brand, region, regr_slope(run, x) FILTER (WHERE hist) AS s, regr_intercept(run, x) FILTER (WHERE hist) AS i
       FROM cs GROUP BY 1, 2),
cumsum AS (SELECT cs.brand, cs.region, cs.week, cs.week_no, i + s * x - lag(i + s * x)
                  OVER (PARTITION BY cs.brand, cs.region ORDER BY cs.week_no) AS yhat
           FROM cs JOIN cf ON cs.brand = cf.brand AND cs.region = cf.region)
"""


@query("ts13_cumsum_trend", f"WITH {_CUMSUM_SQL} SELECT brand, region, week_no, round(yhat, 6) AS yhat FROM cumsum")
def cumsum_trend(t):
    out = ts.cumsum_trend(t.plan, KEYS, "week_no", "daily", F.col("week") <= F.lit(CUT))
    return out.select(*KEYS, "week_no", F.round("yhat", 6).alias("yhat"))


_PHASED_SQL = f"""
{_TREND_SQL}, {_PLACED},
phased AS (SELECT t.*, p.month_start, g.ratio_generic,
                  sum(greatest(t.trendline, 0)) OVER (PARTITION BY t.brand, t.region, p.month_start) * g.ratio_generic AS fc
           FROM trend t JOIN p ON t.brand = p.brand AND t.region = p.region AND t.week = p.week
           JOIN g ON p.brand = g.brand AND p.region = g.region AND p.cw = g.cw AND p.wo = g.wo)
"""


def _phased(frame):
    past = F.col("week") <= F.lit(CUT)
    trend = ts.trendline(frame, KEYS, "week_no", "daily", past)
    shares = ts.phasing_ratio(trend, KEYS, "week", "anchor", "daily", past)
    return shares.withColumn("fc", ts.apply_phasing(shares, KEYS, "month_start", "trendline", "ratio_generic"))


@query("ts14_apply_phasing", f"WITH {_PHASED_SQL} SELECT brand, region, week_no, round(fc, 6) AS forecast FROM phased")
def apply_phasing(t):
    return _phased(t.plan).select(*KEYS, "week_no", F.round("fc", 6).alias("forecast"))


_METHODS = ["cum", "phased", "trend"]


@query("ts15_best_method", f"""
WITH {_PHASED_SQL}, {_CUMSUM_SQL},
m AS (SELECT t.brand, t.region, t.week_no, t.hist, t.daily, greatest(t.trendline, 0) AS trend, t.fc AS phased,
             greatest(coalesce(c.yhat, 0), 0) AS cum
      FROM phased t JOIN cumsum c ON t.brand = c.brand AND t.region = c.region AND t.week = c.week),
n AS (SELECT *, list_sort([cum, phased, trend])[2] AS median_method FROM m),
a AS (SELECT brand, region, round(1 - sum(abs(cum - daily)) / sum(daily), 9) AS cum,
             round(1 - sum(abs(phased - daily)) / sum(daily), 9) AS phased,
             round(1 - sum(abs(trend - daily)) / sum(daily), 9) AS trend,
             round(1 - sum(abs(median_method - daily)) / sum(daily), 9) AS median_method FROM n WHERE NOT hist GROUP BY 1, 2),
b AS (SELECT brand, region, arg_max(method, (fa, -o)) AS method, max(fa) AS fa FROM (
        SELECT brand, region, 'cum' AS method, 1 AS o, cum AS fa FROM a UNION ALL
        SELECT brand, region, 'phased', 2, phased FROM a UNION ALL SELECT brand, region, 'trend', 3, trend FROM a UNION ALL
        SELECT brand, region, 'median_method', 4, median_method FROM a) u WHERE fa > 0 GROUP BY 1, 2)
SELECT n.brand, n.region, n.week_no, coalesce(b.method, 'BLANK') AS method, coalesce(b.fa, 0) AS fa,
       round(median_method, 6) AS median_method,
       round(CASE b.method WHEN 'cum' THEN cum WHEN 'phased' THEN phased WHEN 'trend' THEN trend ELSE median_method END, 6)
       AS proposed
FROM n LEFT JOIN b ON n.brand = b.brand AND n.region = b.region WHERE NOT n.hist
""".replace("arg_max(method, (fa, -o))", "arg_max(method, row(fa, -o))"))
def best_method(t):
    cum = ts.cumsum_trend(t.plan, KEYS, "week_no", "daily", F.col("week") <= F.lit(CUT))
    frame = _phased(cum).where(F.col("week") > F.lit(CUT)).select(
        *KEYS, "week_no", "daily", F.greatest(F.coalesce("yhat", F.lit(0.0)), F.lit(0.0)).alias("cum"),
        F.col("fc").alias("phased"), F.greatest("trendline", F.lit(0.0)).alias("trend"))
    frame = frame.withColumn("median_method", exprs.row_median(*_METHODS))
    frame = evaluation.with_best_method(frame, KEYS, "daily", [*_METHODS, "median_method"])
    proposed = F.col("median_method")
    for m in _METHODS:
        proposed = F.when(F.col("method") == m, F.col(m)).otherwise(proposed)
    return frame.select(
        *KEYS, "week_no", "method", "fa", F.round("median_method", 6).alias("median_method"),
        F.round(proposed, 6).alias("proposed"))


@query("ts16_future_frame", """
SELECT k.brand, k.region, CAST(w AS DATE) AS week
FROM (SELECT DISTINCT brand, region FROM v_weekly) k,
     unnest(generate_series(CAST((SELECT max(week) FROM v_weekly) + 7 AS TIMESTAMP), CAST((SELECT max(week) FROM v_weekly) + 52 * 7 AS TIMESTAMP), INTERVAL 7 DAY)) u(w)
""")
def future_frame(t):
    return ts.future_frame(t.weekly, KEYS, "week", 52)


_MONTHS = 3


def _sec_to_pri_sql():
    """The months before the last one of the secondary series are converted; primary sales are known before them."""
    month = "CAST((SELECT last FROM edge) - INTERVAL {} MONTH AS DATE)"
    parts = [f"""s AS MATERIALIZED (SELECT *, CAST(date_trunc('month', week + 3) AS DATE) AS ms FROM v_weekly_secondary),
edge AS MATERIALIZED (SELECT max(ms) AS last FROM s),
k0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY brand, region, ms) AS cw,
             row_number() OVER (PARTITION BY brand, region, ms ORDER BY week) AS wo
      FROM (SELECT s.brand, s.region, s.week, s.ms, c.working_days AS wd, s.qty AS forecast,
                   CASE WHEN s.ms < {month.format(_MONTHS)} THEN p.qty END AS value
            FROM s JOIN v_full_weeks c ON s.week = c.week
            LEFT JOIN v_weekly p ON s.brand = p.brand AND s.region = p.region AND s.week = p.week) x)"""]
    for i in range(1, _MONTHS + 1):
        first = month.format(_MONTHS + 1 - i)
        parts.append(f"""
h{i} AS (SELECT brand, region, ms, week, wd, coalesce(value, 0) AS v FROM k{i - 1}
       WHERE week BETWEEN CAST({first} - INTERVAL 24 MONTH AS DATE) AND CAST({first} - INTERVAL 1 MONTH AS DATE) + 27),
s{i} AS (SELECT brand, region, v / nullif(sum(v) OVER b, 0) / nullif(wd, 0) AS share, count(*) OVER b AS cw,
              row_number() OVER (PARTITION BY brand, region, ms ORDER BY week) AS wo
       FROM h{i} WINDOW b AS (PARTITION BY brand, region, ms)),
r{i} AS MATERIALIZED (SELECT brand, region, cw, wo, quantile_cont(share, 0.5) AS med FROM s{i} WHERE cw >= 4 GROUP BY ALL),
c{i} AS MATERIALIZED (SELECT k.region, k.cw, k.wo, quantile_cont(r.med, 0.5) AS ratio FROM k{i - 1} k
       LEFT JOIN r{i} r ON k.brand = r.brand AND k.region = r.region AND k.cw = r.cw AND k.wo = r.wo
       WHERE k.ms = {first} GROUP BY ALL),
m{i} AS MATERIALIZED (SELECT k.brand, k.region, k.week, k.ms, k.wd, k.forecast,
              sum(k.forecast) OVER (PARTITION BY k.brand, k.region, k.ms) * c.ratio * k.wd AS value, k.cw, k.wo
       FROM k{i - 1} k LEFT JOIN c{i} c ON k.region = c.region AND k.cw = c.cw AND k.wo = c.wo WHERE k.ms = {first}),
k{i} AS MATERIALIZED (SELECT * FROM k{i - 1} WHERE ms <> {first} UNION ALL SELECT * FROM m{i})""")
    final = " UNION ALL ".join(
        f"SELECT brand, region, week, round(value, 6) AS primary_forecast FROM m{i}" for i in range(1, _MONTHS + 1))
    return "WITH " + ",\n".join(parts) + "\n" + final


@query("ts17_secondary_to_primary", _sec_to_pri_sql())
def secondary_to_primary(t):
    primary = t.weekly.select(*KEYS, "week", F.col("qty").alias("_pri"))
    month = F.trunc(F.date_add("week", 3), "month")
    months = ts.last_full_months(t.weekly_secondary.select(month.alias("month")), "month", _MONTHS)
    frame = t.weekly_secondary.withColumn("working_days", weeks.working_days("week")).join(primary, [*KEYS, "week"], "left").select(
        *KEYS, F.col("region").alias("category"), "week", month.alias("month_start"), "working_days", F.col("qty").alias("forecast"),
        F.when(month < F.lit(min(months, default=None)), F.col("_pri")).alias("primary"))
    out = ts.sec_to_pri(frame, KEYS, "category", months)
    return out.select(*KEYS, "week", F.round("primary_forecast", 6).alias("primary_forecast"))


def _phase_sql(unit, least):
    return f"""
WITH q AS (SELECT *, daily * working_days AS sale, count(*) OVER b AS cw,
                  row_number() OVER (PARTITION BY brand, region, date_trunc('{unit}', anchor) ORDER BY week) AS wo,
                  sum(qty) OVER b AS total
           FROM v_plan WINDOW b AS (PARTITION BY brand, region, date_trunc('{unit}', anchor))),
a AS (SELECT brand, region, cw, wo, avg(share) AS m, quantile_cont(share, 0.5) AS med, stddev_samp(share) AS sd
      FROM (SELECT *, qty / nullif(total, 0) / nullif(working_days, 0) AS share FROM q) s WHERE cw >= {least} GROUP BY ALL)
SELECT brand, region, CAST(cw AS INTEGER) AS count_weeks, CAST(wo AS INTEGER) AS week_order, round(m, 9) AS ratio_mean,
       round(med, 9) AS ratio_median, round(sd, 8) AS ratio_std,
       round(med / nullif(sum(med) OVER (PARTITION BY brand, region, cw), 0), 9) AS ratio_median_normalized
FROM a WHERE med IS NOT NULL
"""


def _phase(t, unit, least):
    out = ts.ratio_phase(t.plan, KEYS, "week", "anchor", "qty", "working_days", unit, least)
    out = ts.normalized_phase(out, KEYS, "ratio_median")
    return out.withColumns({
        "ratio_mean": F.round("ratio_mean", 9), "ratio_median": F.round("ratio_median", 9),
        "ratio_std": F.round("ratio_std", 8), "ratio_median_normalized": F.round("ratio_median_normalized", 9)})


@query("ts18_week_month_phase", _phase_sql("month", 4))
def week_month_phase(t):
    return _phase(t, "month", 4)


@query("ts18_week_quarter_phase", _phase_sql("quarter", 11))
def week_quarter_phase(t):
    return _phase(t, "quarter", 11)


@query("ts19_week_master", """
SELECT w.brand, w.region, w.yearweek, CAST(date_trunc('month', w.week + 3) AS DATE) AS month_start, w.qty FROM v_weekly w
""")
def week_master(t):
    days = t.weekly.select("week").distinct().select(
        F.explode(F.sequence("week", F.date_add("week", 6))).alias("date"))
    return t.weekly.join(ts.week_master(days), "week").select(*KEYS, "yearweek", "month_start", "qty")


def _frame(start, stop):
    return f"({_S} ROWS BETWEEN {start} PRECEDING AND {stop} PRECEDING)"


def _full(fn, start, stop, rows):
    return f"CASE WHEN count(*) OVER {_frame(start, stop)} >= {rows} THEN {fn} OVER {_frame(start, stop)} END"


@query("ts20_ml_lag_features", """SELECT brand, region, week_no, qty, diff, CAST(year(week) AS INTEGER) AS year,
       CAST(month(week) AS INTEGER) AS month, CAST(weekofyear(week) AS INTEGER) AS week, """ + ", ".join(
    [f"lag(diff, {n}) OVER ({_S}) AS diff_lag_{n}" for n in (1, 2, 4, 13, 26, 52)]
    + [f"round({_full('avg(diff)', k + n - 1, k, n)}, 8) AS diff_lag_{k}_mean_{n}" for k in (1, 2, 4, 13, 26) for n in (4, 13, 26)]
    + [f"round({_full('avg(diff)', 55, 52, 4)}, 8) AS diff_lag_52_mean_4"]
    + [f"round(avg(diff) OVER ({_S} ROWS BETWEEN UNBOUNDED PRECEDING AND {k} PRECEDING), 8) AS diff_lag_{k}_expanding" for k in (1, 2)]
) + f" FROM (SELECT brand, region, week, week_no, qty, qty - lag(qty) OVER ({_S}) AS diff FROM v_weekly) d")
def ml_lag_features(t):
    out = ts.ml_lag_features(t.weekly.select(*KEYS, "week_no", "qty", F.col("week").alias("day")), KEYS, "week_no", "qty", "day")
    return _round(out, 8, "qty", "diff")


_STEPS = [52, 58, 65]


@query("ts21_indirect_features", "SELECT brand, region, week_no, qty, " + ", ".join(
    f"round({m}, 8) AS {m}" for m in ("ma4_qty", "ma8_qty", "ma13_qty")) + ", " + ", ".join(
    f"round(CASE WHEN n > {k} THEN coalesce(lag({c}, {k}) OVER ({_S}), first_value({c}) OVER ({_S})) ELSE 0 END, 8) AS lag_{k}_{c}"
    for c in ("qty", "ma4_qty", "ma8_qty", "ma13_qty") for k in _STEPS) + f"""
FROM (SELECT brand, region, week_no, qty, count(*) OVER ({_K}) AS n,
             coalesce({_guard('avg(qty)', '3 PRECEDING', 'CURRENT ROW', 4)}, 0) AS ma4_qty,
             coalesce({_guard('avg(qty)', '7 PRECEDING', 'CURRENT ROW', 8)}, 0) AS ma8_qty,
             coalesce({_guard('avg(qty)', '12 PRECEDING', 'CURRENT ROW', 13)}, 0) AS ma13_qty FROM v_weekly) m""")
def indirect_features(t):
    out = ts.indirect_features(t.weekly.select(*KEYS, "week_no", "qty"), KEYS, "week_no", "qty", [4, 8, 13], _STEPS)
    return _round(out, 8)


@query("ts22_direct_features", "SELECT brand, region, week_no, qty, " + ", ".join(
    [f"max(qty) OVER ({_S} RANGE BETWEEN {26 + s} PRECEDING AND {26 + s} PRECEDING) AS qty_lag_{26 + s}" for s in (0, 1, 2, 4)]
    + [f"round(avg(qty) OVER ({_S} RANGE BETWEEN {26 + n - 1} PRECEDING AND 26 PRECEDING), 8) AS qty_mean_{n}_at_26" for n in (4, 13)]
) + " FROM v_weekly")
def direct_features(t):
    return _round(ts.direct_features(t.weekly.select(*KEYS, "week_no", "qty"), KEYS, "week_no", "qty", 26), 8)


@query("ts23_recursive_forecast", """
WITH s AS (SELECT brand, region, list(qty ORDER BY week_no) AS s, max(week_no) AS last FROM v_weekly GROUP BY 1, 2
           HAVING count(*) >= 52),
a AS (SELECT *, 0.6::DOUBLE * s[-52] + 0.3::DOUBLE * s[-1] + 0.1::DOUBLE * s[-2] AS p1 FROM s),
b AS (SELECT *, 0.6::DOUBLE * s[-51] + 0.3::DOUBLE * p1 + 0.1::DOUBLE * s[-1] AS p2 FROM a),
c AS (SELECT *, 0.6::DOUBLE * s[-50] + 0.3::DOUBLE * p2 + 0.1::DOUBLE * p1 AS p3 FROM b),
d AS (SELECT *, 0.6::DOUBLE * s[-49] + 0.3::DOUBLE * p3 + 0.1::DOUBLE * p2 AS p4 FROM c)
SELECT brand, region, CAST(i AS INTEGER) AS step, CAST(last + i AS INTEGER) AS week_no,
       round([p1, p2, p3, p4][i], 6) AS prediction
FROM d, unnest([1, 2, 3, 4]) u(i)
""")
def recursive_forecast(t):
    def blend(frame, lag):
        return frame.withColumn(
            "prediction", 0.6 * F.col(lag[52]) + 0.3 * F.col(lag[1]) + 0.1 * F.col(lag[2]))

    out = ts.recursive_forecast(t.weekly, KEYS, "week_no", "qty", [1, 2, 52], 4, blend)
    return out.withColumn("prediction", F.round("prediction", 6))


_FOLDS = """
WITH p AS (SELECT week_no, CAST(row_number() OVER (ORDER BY week_no) - 1 AS INTEGER) AS pos, count(*) OVER () AS size
           FROM (SELECT DISTINCT week_no FROM v_weekly) d),
f AS (SELECT x.week_no, o.week_no AS origin, CAST(x.pos - o.pos + 1 AS INTEGER) AS step
      FROM p o JOIN p x ON x.pos BETWEEN o.pos - {train} AND o.pos + 3 WHERE o.pos >= {train} AND o.pos <= o.size - 4)
"""


@query("ts24_rolling_origin", _FOLDS.format(train=52) + """
SELECT w.brand, w.region, w.week_no, w.qty, f.origin, f.step FROM v_weekly w JOIN f ON w.week_no = f.week_no WHERE step > 0
""")
def rolling_origin(t):
    """Test rows of all origins with a year before them."""
    out = ts.rolling_folds(t.weekly.select(*KEYS, "week_no", "qty"), "week_no", 4, 52, roles=["test"])
    return out.drop("role")


@query("ts24_sliding_window", _FOLDS.format(train=26) + """
SELECT w.brand, w.region, f.origin, CASE WHEN step > 0 THEN 'test' ELSE 'train' END AS role, count(*) AS weeks,
       round(avg(qty), 6) AS mean_qty, CAST(min(w.week_no) AS INTEGER) AS first_week
FROM v_weekly w JOIN f ON w.week_no = f.week_no GROUP BY ALL
""")
def sliding_window(t):
    """Half a year of training and four weeks of test of each origin and series."""
    out = ts.rolling_folds(t.weekly.select(*KEYS, "week_no", "qty"), "week_no", 4, 26)
    return out.groupBy(*KEYS, "origin", "role").agg(
        F.count("qty").alias("weeks"), F.round(F.avg("qty"), 6).alias("mean_qty"), F.min("week_no").alias("first_week"))


@query("ts25_backtest_lags", f"""
SELECT c.brand, c.region, c.week_no AS cutoff, CAST(c.week_no + k AS INTEGER) AS week_no, CAST(k AS INTEGER) AS lag_fc,
       c.forecast, coalesce(x.qty, 0) AS actual
FROM (SELECT brand, region, week_no, round(avg(qty) OVER ({_S} RANGE BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS forecast
      FROM v_weekly) c CROSS JOIN unnest([2, 3]) u(k)
LEFT JOIN v_weekly x ON x.brand = c.brand AND x.region = c.region AND x.week_no = c.week_no + k
""")
def backtest_lags(t):
    spec = Window.partitionBy(*KEYS).orderBy("week_no").rangeBetween(-3, 0)
    made = t.weekly.select(*KEYS, F.col("week_no").alias("cutoff"), F.round(F.avg("qty").over(spec), 4).alias("forecast"))
    steps = made.select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("_k")).select(
        *KEYS, "cutoff", "forecast", (F.col("cutoff") + F.col("_k")).alias("week_no"))
    return ts.backtest_lags(steps, t.weekly, KEYS, "week_no", "qty", [2, 3])


@query("ts26_performance_features", f"""
SELECT brand, region, week_no, r, sum(r) OVER (PARTITION BY region, week_no) AS region_performance,
       sum(r) OVER (PARTITION BY brand, week_no) AS brand_performance
FROM (SELECT brand, region, week_no, sum(qty) OVER ({_S} RANGE BETWEEN 8 PRECEDING AND 5 PRECEDING) AS r FROM v_weekly) x
""")
def performance_features(t):
    spec = Window.partitionBy(*KEYS).orderBy("week_no").rangeBetween(-8, -5)
    rolled = t.weekly.select(*KEYS, "week_no", F.sum("qty").over(spec).alias("r"))
    return ts.performance_features(
        rolled, {"region_performance": ["region", "week_no"], "brand_performance": ["brand", "week_no"]}, "r")


@query("ts27_active_days", """
SELECT brand, yearweek, active_days, lag(active_days, 4) OVER w AS active_days_lag_4,
       lag(active_days, 8) OVER w AS active_days_lag_8
FROM (SELECT brand, CAST(year(date) * 100 + ceil(dayofyear(date) / 7.0) AS INTEGER) AS yearweek,
             count(*) FILTER (WHERE qty > 0) AS active_days FROM v_daily GROUP BY 1, 2) a
WINDOW w AS (PARTITION BY brand ORDER BY yearweek)
""")
def active_days(t):
    return ts.active_days(t.daily, ["brand"], "date", "qty", [4, 8])


@query("ts28_route_series", """
SELECT product, avg(qty) AS mean_sales, count(*) AS days, CASE WHEN avg(qty) < 1 THEN 'low_performance'
       WHEN count(*) < 91 THEN 'low_num_of_days' WHEN count(*) >= 300 THEN 'normal_and_auto' ELSE 'normal' END AS route
FROM (SELECT product, date, sum(qty) AS qty FROM v_lines GROUP BY 1, 2) d GROUP BY 1
""")
def route_series(t):
    by_day = t.primary_lines.groupBy("product", "date").agg(F.sum("qty").alias("qty"))
    return ts.route_series(by_day, ["product"], "qty")


@query("ts29_time_split", f"""
SELECT brand, region, week_no, qty, CASE WHEN row_number() OVER ({_S}) <= floor(count(*) OVER ({_K}) * 0.9::DOUBLE)
       THEN 'train' ELSE 'test' END AS part
FROM v_weekly
""")
def time_split(t):
    return ts.time_split(t.weekly.select(*KEYS, "week_no", "qty"), KEYS, "week_no", 0.9)


@query("ts30_autocorrelation", f"""
WITH l AS (SELECT brand, region, qty AS y, lag(qty, 1) OVER ({_S}) AS l1, lag(qty, 2) OVER ({_S}) AS l2,
                  lag(qty, 3) OVER ({_S}) AS l3 FROM v_weekly),
c AS (SELECT brand, region, corr(y, l1) AS r1, corr(y, l2) AS r2, corr(y, l3) AS r3,
             regr_slope(y - l1, l1) AS b, regr_syy(y - l1, l1) AS syy, regr_sxx(y - l1, l1) AS sxx, count(l1) AS n
      FROM l GROUP BY 1, 2),
p AS (SELECT *, r1 AS p1, (r2 - r1 * r1) / (1 - r1 * r1) AS p2 FROM c),
q AS (SELECT *, p1 - p2 * p1 AS f21 FROM p)
SELECT brand, region, round(r1, 8) AS acf_1, round(r2, 8) AS acf_2, round(r3, 8) AS acf_3, round(p1, 8) AS pacf_1,
       round(p2, 8) AS pacf_2, round((r3 - f21 * r2 - p2 * r1) / (1 - f21 * r1 - p2 * r2), 8) AS pacf_3,
       round(b / sqrt((syy - b * b * sxx) / (n - 2) / sxx), 6) AS unit_root_t
FROM q
""")
def autocorrelation(t):
    out = ts.autocorrelation(t.weekly, KEYS, "week_no", "qty", 3)
    rounded = {c: F.round(c, 8) for c in out.columns if "acf" in c}
    return out.withColumns({**rounded, "unit_root_t": F.round("unit_root_t", 6)})


@query("ts31_map_groups", """
WITH RECURSIVE y AS (SELECT brand, region, qty, row_number() OVER (PARTITION BY brand, region ORDER BY week_no) AS n,
                            count(*) OVER (PARTITION BY brand, region) AS periods FROM v_weekly),
r AS (SELECT brand, region, i, i / 20.0::DOUBLE AS alpha, n, qty AS level, 0.0::DOUBLE AS sse FROM y, unnest(range(1, 20)) u(i) WHERE n = 1
      UNION ALL
      SELECT r.brand, r.region, r.i, r.alpha, y.n, r.level + r.alpha * (y.qty - r.level), r.sse + (y.qty - r.level) * (y.qty - r.level)
      FROM r JOIN y ON r.brand = y.brand AND r.region = y.region AND y.n = r.n + 1)
SELECT r.brand, r.region, alpha, round(level, 6) AS level, round(sse / (periods - 1), 5) AS mse, periods, CAST(NULL AS VARCHAR) AS error
FROM r JOIN (SELECT DISTINCT brand, region, periods FROM y) z ON r.brand = z.brand AND r.region = z.region AND r.n = z.periods
WHERE periods >= 3 QUALIFY row_number() OVER (PARTITION BY r.brand, r.region ORDER BY sse, i) = 1
UNION ALL
SELECT DISTINCT brand, region, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT),
       'ValueError: ' || periods || ' of 3 periods' FROM y WHERE periods < 3
""")
def map_groups(t):
    out = ts.smoothed(t.weekly, KEYS, "week_no", "qty", [i / 20 for i in range(1, 20)])
    return out.withColumns({"level": F.round("level", 6), "mse": F.round("mse", 5)})


_TWO = """(SELECT a.brand, a.region, a.week, a.week_no, a.qty AS "primary", b.qty AS secondary FROM v_weekly a
           JOIN v_weekly_secondary b ON a.brand = b.brand AND a.region = b.region AND a.week = b.week) z"""

_RATIO_SQL = f"""
g AS (SELECT *, (secondary - "primary") / nullif("primary", 0) AS ratio_week,
             (sum(secondary) OVER m - sum("primary") OVER m) / nullif(sum("primary") OVER m, 0) AS ratio_month,
             (sum(secondary) OVER q - sum("primary") OVER q) / nullif(sum("primary") OVER q, 0) AS ratio_quarter
      FROM {_TWO} WINDOW m AS (PARTITION BY brand, region, date_trunc('month', week)),
                         q AS (PARTITION BY brand, region, date_trunc('quarter', week)))
"""


def _two_facts(t):
    return t.weekly.select(*KEYS, "week", "week_no", F.col("qty").alias("primary")).join(
        t.weekly_secondary.select(*KEYS, "week", F.col("qty").alias("secondary")), [*KEYS, "week"])


@query("ts32_secondary_primary_ratio", f"""
WITH {_RATIO_SQL}
SELECT brand, region, week_no, ratio_week, ratio_month, ratio_quarter,
       round({_guard('avg(ratio_week)', '3 PRECEDING', 'CURRENT ROW', 4)}, 8) AS ma_week_month,
       round({_guard('avg(ratio_week)', '12 PRECEDING', 'CURRENT ROW', 13)}, 8) AS ma_week_quarter,
       round({_guard('avg(ratio_month)', '2 PRECEDING', 'CURRENT ROW', 3)}, 8) AS ma_month_quarter
FROM g
""")
def secondary_primary_ratio(t):
    out = ts.sec_pri_ratio(_two_facts(t), KEYS, "week", "week_no")
    means = ["ma_week_month", "ma_week_quarter", "ma_month_quarter"]
    return out.select(*KEYS, "week_no", "ratio_week", "ratio_month", "ratio_quarter",
                      *[F.round(c, 8).alias(c) for c in means])


_GRAINS = {"week": "weekofyear(week)", "month": "month(week)", "quarter": "quarter(week)"}


@query("ts33_seasonal_index", f"""
WITH {_RATIO_SQL},
v AS ({" UNION ALL ".join(
    f"SELECT '{g}' AS grain, CAST({c} AS INTEGER) AS period, {'isoyear' if g == 'week' else 'year'}(week) AS year, avg(ratio_{g}) AS mean FROM g GROUP BY 2, 3"
    for g, c in _GRAINS.items())}),
y AS (SELECT grain, max(year) AS last, count(DISTINCT year) AS years FROM v GROUP BY 1)
SELECT grain, period, round(sum(mean) / max(years), 8) AS index_all, {", ".join(
    f"round(coalesce(sum(mean) FILTER (WHERE year > last - {n}), 0) / {n}, 8) AS index_{n}y" for n in (1, 2, 3))}
FROM v JOIN y USING (grain) GROUP BY 1, 2
""")
def seasonal_index(t):
    ratios = ts.sec_pri_ratio(_two_facts(t), KEYS, "week", "week_no")
    out = None
    for grain, period in (("week", F.weekofyear("week")), ("month", F.month("week")), ("quarter", F.quarter("week"))):
        year = F.extract(F.lit("YEAROFWEEK"), F.col("week")) if grain == "week" else F.year("week")
        part = ts.seasonal_index(
            ratios.select(period.alias("period"), year.alias("year"), f"ratio_{grain}"), "period", "year", f"ratio_{grain}", (1, 2, 3))
        part = part.withColumn("grain", F.lit(grain))
        out = part if out is None else out.unionByName(part)
    return _round(out, 8)


@query("ts34_ratio_from_forecast", """
SELECT brand, region, week_no, round(qty * 1.05::DOUBLE / working_days / sum(qty * 1.05::DOUBLE) OVER
       (PARTITION BY brand, region, date_trunc('month', anchor)), 10) AS ratio_week_month,
       round(qty * 1.05::DOUBLE / working_days / sum(qty * 1.05::DOUBLE) OVER
       (PARTITION BY brand, region, date_trunc('quarter', anchor)), 10) AS ratio_week_quarter
FROM v_plan
""")
def ratio_from_forecast(t):
    frame = t.plan.withColumn("forecast", F.col("qty") * 1.05)
    out = ts.ratio_from_forecast(frame, KEYS, "anchor", "forecast", "working_days")
    return out.select(*KEYS, "week_no", F.round("ratio_week_month", 10).alias("ratio_week_month"),
                      F.round("ratio_week_quarter", 10).alias("ratio_week_quarter"))


@query("ts35_holiday_context", """
WITH c AS (SELECT week, yearweek, CASE WHEN working_days < 6 THEN 'HOLIDAY' ELSE 'NORMAL' END AS name FROM v_weeks
           WHERE yearweek % 100 <> 53),
h AS (SELECT week, yearweek, """ + ", ".join(
    ["CAST(name = 'HOLIDAY' AS INTEGER) AS holiday_HOLIDAY"]
    + [f"CAST(coalesce({f}(name, {k}) OVER (ORDER BY week) = 'HOLIDAY', FALSE) AS INTEGER) AS holiday_{s}_{k}_HOLIDAY"
       for k in (1, 2, 3, 4) for f, s in (("lag", "past"), ("lead", "forward"))]) + """ FROM c)
SELECT w.brand, w.region, w.qty, h.* EXCLUDE (week) FROM v_weekly w JOIN h ON w.week = h.week
""")
def holiday_context(t):
    calendar = weeks.week_calendar(t.spark, *t.span).withColumn(
        "name", F.when(F.col("working_days") < 6, "HOLIDAY").otherwise("NORMAL"))
    context = ts.holiday_context(calendar, "week", "name", 4, ["HOLIDAY"]).drop("yearweek")
    return t.weekly.select(*KEYS, "week", "yearweek", "qty").join(context, "week").drop("week")
