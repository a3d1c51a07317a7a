"""Queries: forecast and classification evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.operators import evaluation as ops
from aisle.plans.registry import query

METHODS = ["fc_year", "fc_week", "fc_mean"]


def _rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_FA = "round(1 - sum(abs({p} - actual)) / nullif(sum(actual), 0), 9) AS fa"
_FB = "round(sum({p} - actual) / nullif(sum(actual), 0), 9) AS fb"
_YEAR = f"{_FA.format(p='fc_year')}, {_FB.format(p='fc_year')}"


@query("evl01_accuracy_bias", f"SELECT brand, region, {_YEAR} FROM v_forecasts GROUP BY 1, 2")
def accuracy_bias(t):
    return _rounded(ops.accuracy_by(t.forecasts, ["brand", "region"], "actual", "fc_year"), "fa", "fb")


@query("evl02_row_accuracy_by_tier", """
WITH r AS (SELECT brand, region, CASE WHEN sum(actual) > 9000 THEN 9000 WHEN sum(actual) > 7000 THEN 7000
                  WHEN sum(actual) > 5000 THEN 5000 ELSE 0 END AS tier FROM v_forecasts GROUP BY 1, 2)
SELECT tier, round(avg(1 - abs(fc_year - actual) / CASE WHEN actual = 0 THEN actual + 1 ELSE actual END), 8) AS mean_fa
FROM v_forecasts f JOIN r ON f.brand = r.brand AND f.region = r.region GROUP BY 1
""")
def row_accuracy_by_tier(t):
    total = F.sum("actual")
    tiers = t.forecasts.groupBy("brand", "region").agg(
        F.when(total > 9000, 9000).when(total > 7000, 7000).when(total > 5000, 5000).otherwise(0).alias("tier"))
    return t.forecasts.join(tiers, ["brand", "region"]).groupBy("tier").agg(
        F.round(F.avg(ops.row_accuracy("actual", "fc_year")), 8).alias("mean_fa"))


_LONG = " UNION ALL ".join(
    f"SELECT brand, region, week_no, actual, '{m}' AS method, {m} AS p FROM v_forecasts" for m in METHODS)
_TABLE = """round(1 - sum(abs(p - actual)) / nullif(sum(actual), 0), 9) AS fa, round(sum(abs(p - actual)), 4) AS error,
       sum(actual) AS sum_actual, round(sum(p), 4) AS sum_predict, round(avg(abs(p - actual)), 6) AS mae,
       round(sqrt(avg((p - actual) * (p - actual))), 6) AS rmse"""


@query("evl03_method_table", f"SELECT brand, method, {_TABLE} FROM ({_LONG}) l GROUP BY 1, 2")
def method_table(t):
    out = ops.method_table(t.forecasts, ["brand"], "actual", METHODS)
    return out.withColumns({
        "fa": F.round("fa", 9), "error": F.round("error", 4), "sum_predict": F.round("sum_predict", 4),
        "mae": F.round("mae", 6), "rmse": F.round("rmse", 6)})


@query("evl04_bias_report", """
SELECT *, volume / sum(volume) OVER () AS contribution
FROM (SELECT CASE WHEN actual < 100 THEN CAST(CAST(actual AS INTEGER) AS VARCHAR) ELSE '>= 100' END AS segment,
             count(*) AS records, sum(actual) AS volume, round(avg(actual), 8) AS mean_actual,
             round(avg(fc_year), 6) AS mean_predicted, round(sum(least(fc_year - actual, 0)), 4) AS negative_bias,
             round(sum(greatest(fc_year - actual, 0)), 4) AS positive_bias
      FROM v_forecasts GROUP BY 1) s
""")
def bias_report(t):
    segment = F.when(F.col("actual") < 100, F.col("actual").cast("int").cast("string")).otherwise(">= 100")
    out = ops.bias_report(t.forecasts, segment, "actual", "fc_year")
    return out.withColumns({
        "mean_actual": F.round("mean_actual", 8), "mean_predicted": F.round("mean_predicted", 6),
        "negative_bias": F.round("negative_bias", 4), "positive_bias": F.round("positive_bias", 4)})


_QUARTERS = [1, 2, 3, 4]


@query("evl05_accuracy_matrix", "SELECT brand, " + ", ".join(
    f"round(1 - sum(abs(fc_year - actual)) FILTER (WHERE q = {q}) / nullif(sum(actual) FILTER (WHERE q = {q}), 0), 9) AS fa_{q}"
    for q in _QUARTERS) + ", " + ", ".join(
    f"round(sum(fc_year - actual) FILTER (WHERE q = {q}) / nullif(sum(actual) FILTER (WHERE q = {q}), 0), 9) AS fb_{q}"
    for q in _QUARTERS) + """ FROM (SELECT *, CAST(((yearweek % 100) - 1) // 14 + 1 AS INTEGER) AS q FROM v_forecasts) x
GROUP BY 1""")
def accuracy_matrix(t):
    bucketed = t.forecasts.withColumn("q", (F.floor((F.col("yearweek") % 100 - 1) / 14) + 1).cast("int"))
    out = ops.accuracy_matrix(bucketed, ["brand"], "q", _QUARTERS, "actual", "fc_year")
    return _rounded(out, *[f"{name}_{q}" for name in ("fa", "fb") for q in _QUARTERS])


@query("evl06_accuracy_levels", " UNION ALL ".join(
    f"SELECT '{c}' AS level, CAST({c} AS VARCHAR) AS value, {_YEAR} FROM v_forecasts GROUP BY 2"
    for c in ("brand", "region", "yearweek")))
def accuracy_levels(t):
    return _rounded(ops.accuracy_levels(t.forecasts, ["brand", "region", "yearweek"], "actual", "fc_year"), "fa", "fb")


_WEEKS = [1, 2, 3, 4]


@query("evl07_precision_by_week", """
WITH w AS (SELECT outlet, channel, wk, count(*) AS n FROM (
             SELECT x.outlet, o.channel, date_diff('day', DATE '2000-03-01', x.date) // 7 + 1 AS wk
             FROM v_sales x JOIN v_outlets o ON x.outlet = o.outlet
             WHERE x.date BETWEEN DATE '2000-03-01' AND DATE '2000-03-28') a GROUP BY 1, 2, 3),
p AS (SELECT outlet, wk FROM (SELECT outlet, date_diff('day', DATE '1999-03-01', date) // 7 + 1 AS wk FROM v_sales
      WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-03-28') b GROUP BY 1, 2),
g AS (SELECT o.channel, o.outlet, """ + ", ".join(
    f"o.outlet IN (SELECT outlet FROM w WHERE wk = {i}) AS b{i}, o.outlet IN (SELECT outlet FROM p WHERE wk = {i}) AS p{i}"
    for i in _WEEKS) + """ FROM v_outlets o)
SELECT channel, """ + ", ".join(
    f"coalesce(count(*) FILTER (WHERE b{i} AND p{i}) / nullif(count(*) FILTER (WHERE p{i}), 0), 0) AS w{i}_precision"
    for i in _WEEKS) + """,
  coalesce(count(*) FILTER (WHERE (b1 OR b2 OR b3 OR b4) AND (p1 OR p2 OR p3 OR p4))
           / nullif(count(*) FILTER (WHERE p1 OR p2 OR p3 OR p4), 0), 0) AS total_precision
FROM g GROUP BY 1
""")
def precision_by_week(t):
    sales = t.sales.select("outlet", "date")
    bought = {}
    for year, name in ((2000, "b"), (1999, "p")):
        week = F.floor(F.datediff("date", F.lit(f"{year}-03-01").cast("date")) / 7) + 1
        bought |= {f"{name}{i}": F.max((week == i).cast("int")) for i in _WEEKS}
    flags = sales.where(
        F.col("date").between(F.lit("2000-03-01").cast("date"), F.lit("2000-03-28").cast("date"))
        | F.col("date").between(F.lit("1999-03-01").cast("date"), F.lit("1999-03-28").cast("date"))
    ).groupBy("outlet").agg(*[c.alias(n) for n, c in bought.items()])
    frame = t.outlets.select("outlet", "channel").join(flags, "outlet", "left").na.fill(0, list(bought))
    hit = lambda name: F.col(name) == 1
    any_of = lambda name: F.greatest(*[F.col(f"{name}{i}") for i in _WEEKS]) == 1
    pairs = {f"w{i}_precision": (hit(f"b{i}"), hit(f"p{i}")) for i in _WEEKS}
    return ops.precision_table(frame, ["channel"], {**pairs, "total_precision": (any_of("b"), any_of("p"))})


@query("evl08_classification_scores", """
SELECT lang, tp, fp, fn, tn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / nullif(tp + fp, 0) AS precision,
       tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1
FROM (SELECT lang, count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp,
             count(*) FILTER (WHERE quality <> 1 AND score >= 0.5) AS fp,
             count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn,
             count(*) FILTER (WHERE quality <> 1 AND score < 0.5) AS tn FROM v_scores GROUP BY 1) c
""")
def classification_scores(t):
    return ops.classification_scores(t.scores, ["lang"], F.col("quality") == 1, F.col("score") >= 0.5)


_CURVE = """
WITH c AS (SELECT score, sum(quality) AS pos, sum(1 - quality) AS neg FROM v_scores GROUP BY 1),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap, sum(neg) OVER () AS an
      FROM c WINDOW w AS (ORDER BY score DESC))
"""


@query("evl09_roc_curve", _CURVE + "SELECT score, tp / ap AS tpr, fp / an AS fpr, tp / (tp + fp) AS precision FROM r")
def roc_curve(t):
    return ops.roc_curve(t.scores, "score", "quality")


@query("evl09_areas", _CURVE + """,
k AS (SELECT *, tp / ap AS tpr, fp / an AS fpr, tp / (tp + fp) AS prec,
             coalesce(lag(tp / ap) OVER w, 0) AS tpr0, coalesce(lag(fp / an) OVER w, 0) AS fpr0,
             coalesce(lag(tp / (tp + fp)) OVER w, 1) AS prec0 FROM r WINDOW w AS (ORDER BY score DESC))
SELECT round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 9) AS roc_auc, round(sum((tpr - tpr0) * (prec + prec0) / 2), 9) AS pr_auc
FROM k
""")
def areas(t):
    return _rounded(ops.areas_under_curves(t.scores, "score", "quality"), "roc_auc", "pr_auc")


_GRID = [round(i / 10, 1) for i in range(10)]


@query("evl10_best_threshold", f"""
SELECT threshold, f1 FROM (
  SELECT h AS threshold, 2 * count(*) FILTER (WHERE quality = 1 AND score >= h)
         / (count(*) FILTER (WHERE quality = 1) + count(*) FILTER (WHERE score >= h)) AS f1
  FROM v_scores, unnest([{", ".join(f"{h}::DOUBLE" for h in _GRID)}]) g(h) GROUP BY 1) x
ORDER BY f1 DESC, threshold DESC LIMIT 1
""")
def best_threshold(t):
    return ops.best_threshold(t.scores, "score", "quality", _GRID)


@query("evl11_regression_scores", """
SELECT region, round(1 - sum((actual - fc_mean) * (actual - fc_mean)) / nullif(var_pop(actual) * count(*), 0), 8) AS r2,
       round(avg((actual - fc_mean) * (actual - fc_mean)), 6) AS mse, round(avg(abs(actual - fc_mean)), 6) AS mae
FROM v_forecasts GROUP BY 1
""")
def regression_scores(t):
    out = ops.regression_scores(t.forecasts, ["region"], "actual", "fc_mean")
    return out.withColumns({"r2": F.round("r2", 8), "mse": F.round("mse", 6), "mae": F.round("mae", 6)})


@query("evl12_label_agreement", """
SELECT source, avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END) AS agreement, count(*) AS docs
FROM v_scores GROUP BY 1
""")
def label_agreement(t):
    same = F.when(F.col("quality") == F.col("toxic"), 1.0).otherwise(0.0)
    return t.scores.groupBy("source").agg(F.avg(same).alias("agreement"), F.count("doc_id").alias("docs"))


@query("evl13_label_rate", """
SELECT lang, avg(quality) FILTER (WHERE score < 0.3) AS low, avg(quality) FILTER (WHERE score >= 0.3 AND score < 0.6) AS mid,
       avg(quality) FILTER (WHERE score >= 0.6) AS high
FROM v_scores GROUP BY 1
""")
def label_rate(t):
    level = F.when(F.col("score") < 0.3, "low").when(F.col("score") < 0.6, "mid").otherwise("high")
    return t.scores.withColumn("level", level).groupBy("lang").pivot("level", ["low", "mid", "high"]).agg(
        F.avg("quality"))


_FAFB = f"SELECT brand, region, method, {_FA.format(p='p')}, {_FB.format(p='p')} FROM ({_LONG}) l GROUP BY 1, 2, 3"


@query("evl14_select_model", f"""
SELECT brand, region, method, fa, fb, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS fb_check
FROM (SELECT *, row_number() OVER (PARTITION BY brand, region ORDER BY ok DESC, fa DESC, method DESC) AS rn
      FROM (SELECT *, abs(fb) < 0.001 AS ok FROM ({_FAFB}) m) a) b WHERE rn = 1
""")
def select_model(t):
    long = t.forecasts.unpivot(["brand", "region", "actual"], METHODS, "method", "p")
    table = _rounded(ops.accuracy_by(long, ["brand", "region", "method"], "actual", "p"), "fa", "fb")
    return ops.select_model(table, ["brand", "region"], 0.001)


@query("evl15_uplift_description", """
SELECT brand, round(sum(qty - base), 4) AS uplift, round(sum(qty - base) / sum(base), 9) AS uplift_share,
       round(avg(CASE WHEN base = 0 THEN 0 ELSE (qty - base) / base END), 8) AS mean_pct, count(*) AS weeks
FROM (SELECT brand, qty, qty - promo_qty AS base FROM v_weekly WHERE promo_qty > 0) x WHERE base > 0 GROUP BY 1
""")
def uplift_description(t):
    base = F.col("qty") - F.col("promo_qty")
    frame = t.weekly.where("promo_qty > 0").select("brand", "qty", base.alias("base")).where("base > 0")
    gap = F.col("qty") - F.col("base")
    return frame.groupBy("brand").agg(
        F.round(F.sum(gap), 4).alias("uplift"), F.round(F.sum(gap) / F.sum("base"), 9).alias("uplift_share"),
        F.round(F.avg(gap / F.col("base")), 8).alias("mean_pct"), F.count("qty").alias("weeks"))


@query("evl16_group_accuracy", f"""
WITH l AS ({_LONG}),
k AS (SELECT brand, region, method, round(1 - sum(abs(p - actual)) / sum(actual), 9) AS fa, sum(actual) AS sales FROM l GROUP BY 1, 2, 3),
b AS (SELECT region, brand, max(greatest(fa, 0)) AS fa, max(sales) AS sales FROM k GROUP BY 1, 2),
t AS (SELECT region, method, round(1 - sum(abs(p - actual)) / sum(actual), 9) AS fa FROM l GROUP BY 1, 2)
SELECT x.region, x.method, x.fa, y.median_fa, y.weighted_fa
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY fa DESC,
      CASE method WHEN 'fc_year' THEN 1 WHEN 'fc_week' THEN 2 ELSE 3 END) AS rn FROM t) q WHERE rn = 1) x
JOIN (SELECT region, round(quantile_cont(fa, 0.5), 10) AS median_fa, round(sum(fa * sales) / sum(sales), 9) AS weighted_fa
      FROM b GROUP BY 1) y ON x.region = y.region
""")
def group_accuracy(t):
    out = ops.group_accuracy(t.forecasts, "region", "brand", "actual", METHODS)
    return out.withColumns({"median_fa": F.round("median_fa", 10), "weighted_fa": F.round("weighted_fa", 9)})
