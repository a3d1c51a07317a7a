"""Queries: data quality."""

from __future__ import annotations

from pyspark.sql import Window, functions as F


from aisle.functions import exprs
from aisle.operators import joins, quality as ops
from aisle.plans.registry import query

KEYS = ["brand", "region"]
RUN_WEEK = 1650  # running number of the ISO week of 2001-08-20
_S = "PARTITION BY brand, region ORDER BY week_no"

_LABELLED = """(SELECT d.doc_id, nullif(d.source, 'src0') AS source, l.quality, l.toxic
                FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) x"""


def _labelled(t):
    return t.documents.select("doc_id", F.nullif("source", F.lit("src0")).alias("source")).join(
        t.labels, "doc_id", "left")


@query("dq01_null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM {_LABELLED}"
    for c in ("doc_id", "source", "quality", "toxic")))
def null_profile(t):
    return ops.null_profile(_labelled(t), ["doc_id", "source", "quality", "toxic"])


@query("dq02_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev,
        min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS p25,
        round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75 FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def summary(t):
    out = ops.summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"],
                      {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "p25", "p50", "p75")})


_CONTRACT = [
    ops.Rule("order_no", "number", r"[0-9]+$", nullable=False, null_message="no number"),
    ops.Rule("order_date", "datetime", "yyyyMMdd", nullable=False, type_message="bad date"),
    ops.Rule("price", "number", r"[0-9]{4,6}[.][0-9]{2}$", low=5000, high=450000),
]
_RAW = """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 30000 THEN NULL
            ELSE CAST(o_orderkey AS VARCHAR) END AS order_no,
       CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
            ELSE strftime(o_orderdate, '%Y%m%d') END AS order_date,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 470000 THEN NULL
            WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 470000 THEN 'n/a'
            ELSE printf('%.2f', o_totalprice) END AS price
FROM orders"""


@query("dq03_contract", f"""
SELECT id, order_no, order_date, price, nullif(concat('order_no:', no_err), 'order_no:') AS order_no_check,
       nullif(concat('order_date:', date_err), 'order_date:') AS order_date_check,
       nullif(concat('price:', price_err), 'price:') AS price_check,
       concat_ws(',', nullif(concat('order_no:', no_err), 'order_no:'), nullif(concat('order_date:', date_err), 'order_date:'),
                 nullif(concat('price:', price_err), 'price:')) AS summary_check,
       CASE WHEN no_err <> '' OR date_err <> '' OR price_err <> '' THEN 'x' ELSE '' END AS fail_case
FROM (SELECT *, concat_ws(' ', CASE WHEN order_no IS NULL THEN 'no number wrong type' END) AS no_err,
             CASE WHEN NOT regexp_matches(order_date, '^[0-9]{{8}}$') THEN 'bad date' ELSE '' END AS date_err,
             concat_ws(' ', CASE WHEN NOT regexp_matches(coalesce(price, '0'), '^[0-9]{{4,6}}[.][0-9]{{2}}$')
                            THEN 'wrong type' END,
                       CASE WHEN coalesce(try_cast(coalesce(price, '0') AS DOUBLE) BETWEEN 5000 AND 450000, FALSE) = FALSE
                            THEN 'out of range' END) AS price_err
      FROM ({_RAW}) r) z
""")
def contract(t):
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    raw = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when((status == "P") & (price < 30000), None).otherwise(F.col("o_orderkey").cast("string")).alias("order_no"),
        F.when((priority == "5-LOW") & (status == "F"), F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("order_date"),
        F.when((priority == "1-URGENT") & (price > 470000), None)
        .when((priority == "2-HIGH") & (price > 470000), "n/a")
        .otherwise(price.cast("decimal(18,2)").cast("string")).alias("price"))
    return ops.validate(raw, _CONTRACT)


@query("dq04_series_eligibility", f"""
SELECT *, CAST({RUN_WEEK} - last_week AS INTEGER) AS cutoff_gap,
       CASE WHEN week_count < 26 OR {RUN_WEEK} - last_week > 26 THEN 'ABSOLUTELY_NOT' WHEN week_count < 52 THEN 'MAYBE'
            ELSE 'ABSOLUTELY' END AS verdict,
       CASE WHEN {RUN_WEEK} - first_week < 26 THEN 'NEW' WHEN {RUN_WEEK} - last_week > 26 THEN 'INACTIVE'
            WHEN week_count < 52 THEN 'OLD BUT LACKING SALES' ELSE 'OLD AND ACTIVE' END AS age_class
FROM (SELECT product, count(*) AS week_count, max(week_no) AS last_week, min(week_no) AS first_week, sum(qty) AS total,
             avg(qty) AS mean, max(qty) AS highest, min(qty) AS lowest
      FROM v_product_weekly WHERE week_no <= {RUN_WEEK} GROUP BY product) s
""")
def series_eligibility(t):
    return ops.series_eligibility(t.product_weekly, ["product"], "week_no", "qty", RUN_WEEK)


_SERIES_FLAGS = """
WITH s AS (SELECT product, count(*) AS n, max(week_no) AS last FROM v_product_weekly GROUP BY 1),
f AS (SELECT product, n <= 26 AS short, n BETWEEN 26 AND 52 AS warn,
             last <= (SELECT max(last) FROM s) - 26 AS stale FROM s)
"""


@query("dq05_validate_series", _SERIES_FLAGS + """
SELECT count(*) AS total, count(*) FILTER (WHERE NOT short AND NOT stale) AS usable,
       count(*) FILTER (WHERE short) AS up_to_26_weeks, count(*) FILTER (WHERE warn) AS up_to_52_weeks,
       count(*) FILTER (WHERE stale) AS stale
FROM f
""")
def validate_series(t):
    return ops.validate_series(t.product_weekly, ["product"], "week_no")[1]


@query("dq05_usable_series", _SERIES_FLAGS + """
SELECT product, week_no, qty FROM v_product_weekly
WHERE product IN (SELECT product FROM f WHERE NOT short AND NOT stale)
""")
def usable_series(t):
    return ops.validate_series(t.product_weekly, ["product"], "week_no")[0]


@query("dq06_reconcile", """
SELECT coalesce(a.product, e.product) AS product, CASE WHEN e.product IS NULL THEN 'NOT_EXPECTED'
       WHEN a.product IS NULL THEN 'NO LE RECORD' ELSE 'NO ERROR' END AS status
FROM (SELECT DISTINCT product FROM v_sales) a FULL JOIN (SELECT product FROM v_products) e ON a.product = e.product
""")
def reconcile(t):
    return ops.reconcile(t.sales, t.products, ["product"])


_COVERAGE = """
WITH g AS (SELECT k.brand, k.region, w.week_no,
                  CAST(round(CAST(CAST(x.return_qty / nullif(x.qty, 0) AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE) AS rate
           FROM (SELECT DISTINCT brand, region FROM v_weekly) k
           JOIN (SELECT week_no FROM v_weeks WHERE week_no BETWEEN (SELECT min(week_no) FROM v_weekly)
                 AND (SELECT max(week_no) FROM v_weekly)) w ON TRUE
           LEFT JOIN v_weekly x ON x.brand = k.brand AND x.region = k.region AND x.week_no = w.week_no),
p AS (SELECT brand, region, count(*) FILTER (WHERE rate IS NULL) AS null_count,
             count(*) FILTER (WHERE rate = 0) AS zero_count, count(*) FILTER (WHERE rate = 1) AS one_count,
             count(rate) AS present_count, count(*) AS total_count,
             round(count(*) FILTER (WHERE rate IS NULL) / count(*), 2) AS null_share FROM g GROUP BY 1, 2)
"""


def _rates(t):
    bounds = t.weekly.agg(F.min("week_no").alias("_first"), F.max("week_no").alias("_last"))
    full = exprs.beside(t.weekly.select(*KEYS).distinct(), bounds).select(
        *KEYS, F.explode(F.sequence("_first", "_last")).alias("week_no"))
    rate = F.round(F.try_divide("return_qty", "qty"), 2)
    return full.join(t.weekly.select(*KEYS, "week_no", rate.alias("rate")), [*KEYS, "week_no"], "left")


@query("dq07_coverage_profile", _COVERAGE + "SELECT * FROM p")
def coverage_profile(t):
    return ops.coverage_profile(_rates(t), KEYS, "week_no", "rate")


@query("dq07_split_by_quality", _COVERAGE + """
SELECT g.brand, g.region, g.week_no, g.rate, p.null_share <= 0.3 AS good
FROM g JOIN p ON g.brand = p.brand AND g.region = p.region
""")
def split_by_quality(t):
    rates = _rates(t)
    good, poor = ops.split_by_quality(rates, ops.coverage_profile(rates, KEYS, "week_no", "rate"), KEYS, 0.3)
    return good.withColumn("good", F.lit(True)).unionByName(poor.withColumn("good", F.lit(False)))


@query("dq08_duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_keys(t):
    return ops.dup_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


_PROMO_LINES = """
SELECT x.scheme, x.product, CAST(year(start_date) AS INTEGER) AS post, status, start_date, end_date,
       CASE WHEN mechanic = '1-URGENT' THEN 'discount' ELSE 'gift' END AS mechanic, lower(p.category) AS gift,
       CASE WHEN mechanic = '1-URGENT' THEN discount ELSE 0 END AS tts,
       CASE WHEN mechanic = '1-URGENT' THEN 0 ELSE discount / 2 END AS bmi
FROM v_promotions x JOIN v_products p ON x.product = p.product
"""


def _promo_lines(t):
    urgent = F.col("mechanic") == "1-URGENT"
    return t.promotions.join(t.products.select("product", "category"), "product").select(
        "scheme", "product", F.year("start_date").alias("post"), "status", "start_date", "end_date",
        F.when(urgent, "discount").otherwise("gift").alias("mechanic"), F.lower("category").alias("gift"),
        F.when(urgent, F.col("discount")).otherwise(0.0).alias("tts"),
        F.when(urgent, 0.0).otherwise(F.col("discount") / 2).alias("bmi"))


@query("dq09_promo_rules", f"""
WITH l AS ({_PROMO_LINES}),
d AS (SELECT post, product, date_diff('day', min(start_date), max(end_date)) AS days FROM l GROUP BY 1, 2),
m AS (SELECT DISTINCT 'discount' AS mechanic, lower(category) AS gift FROM v_products
      UNION SELECT DISTINCT 'gift', lower(category) FROM v_products WHERE category <> 'LARGE')
SELECT l.scheme, CAST(status NOT IN ('F', 'O') AS INTEGER) AS status_check,
       CAST(date_diff('day', start_date, end_date) <= 0 AS INTEGER) AS duration_check,
       CAST(d.days < 7 AS INTEGER) AS product_duration_check, CAST(m.gift IS NULL AS INTEGER) AS mapping_check,
       CAST(NOT (tts = 0 OR tts BETWEEN 0.02 AND 0.8) AS INTEGER) AS tts_check,
       CAST(NOT (bmi = 0 OR bmi BETWEEN 0.02 AND 0.8) AS INTEGER) AS bmi_check,
       CAST(l.mechanic = 'discount' AND tts = 0 AS INTEGER) AS tts_missing,
       CAST(l.mechanic = 'gift' AND bmi = 0 AS INTEGER) AS bmi_missing
FROM l JOIN d ON l.post = d.post AND l.product = d.product
LEFT JOIN m ON l.mechanic = m.mechanic AND l.gift = m.gift
""")
def promo_rules(t):
    gifts = t.products.select(F.lower("category").alias("gift"))
    master = gifts.withColumn("mechanic", F.lit("discount")).unionByName(
        gifts.where("gift != 'large'").withColumn("mechanic", F.lit("gift")))
    return ops.promo_rules(_promo_lines(t), master, ["F", "O"])


@query("dq10_promo_conflicts", f"""
WITH l AS ({_PROMO_LINES}),
g AS (SELECT product, post, mechanic, gift, tts, bmi, start_date, end_date, count(*) AS n FROM l GROUP BY ALL),
h AS (SELECT product, post, mechanic, gift, tts, bmi, max(n) AS n, count(*) AS times FROM g GROUP BY ALL),
w AS (SELECT product, post, start_date, end_date, count(*) AS mechanics FROM g GROUP BY ALL)
SELECT a.product, a.post, a.duplicate_line, a.same_mechanic_other_time, b.same_time_other_mechanic
FROM (SELECT product, post, CAST(max(n) > 1 AS INTEGER) AS duplicate_line,
             CAST(max(times) > 1 AS INTEGER) AS same_mechanic_other_time FROM h GROUP BY 1, 2) a
JOIN (SELECT product, post, CAST(max(mechanics) > 1 AS INTEGER) AS same_time_other_mechanic FROM w GROUP BY 1, 2) b
ON a.product = b.product AND a.post = b.post
""")
def promo_conflicts(t):
    return ops.promo_conflicts(_promo_lines(t), ["product", "post"], ["mechanic", "gift", "tts", "bmi"])


@query("dq11_interval_overlaps", f"""
WITH s AS (SELECT product, post, mechanic, tts, bmi, min(start_date) AS start_date, max(end_date) AS end_date
           FROM ({_PROMO_LINES}) l GROUP BY ALL),
k AS (SELECT *, date_diff('day', end_date, lead(start_date) OVER w) AS gap,
             lead(concat_ws('|', mechanic, tts, bmi)) OVER w = concat_ws('|', mechanic, tts, bmi) AS same
      FROM s WINDOW w AS (PARTITION BY product, post ORDER BY start_date, end_date, mechanic, tts, bmi)),
f AS (SELECT *, CAST(coalesce(gap < 0 AND same, FALSE) AS INTEGER) AS a,
             CAST(coalesce(gap < 0 AND NOT same, FALSE) AS INTEGER) AS b FROM k)
SELECT product, post, mechanic, tts, bmi, start_date, end_date, CAST(coalesce(gap, 0) AS INTEGER) AS gap_to_next,
       greatest(a, coalesce(lag(a) OVER w, 0)) AS overlap_same, greatest(b, coalesce(lag(b) OVER w, 0)) AS overlap_other
FROM f WINDOW w AS (PARTITION BY product, post ORDER BY start_date, end_date, mechanic, tts, bmi)
""")
def interval_overlaps(t):
    return ops.interval_overlaps(_promo_lines(t), ["product", "post"], ["mechanic", "tts", "bmi"])


@query("dq12_fact_consistency", """
SELECT brand, region, week_no, coalesce(a.qty, 0) AS a_value, coalesce(b.qty, 0) AS b_value,
       count(a.qty) OVER k AS a_count, count(b.qty) OVER k AS b_count, sum(a.qty) OVER k AS a_total,
       sum(b.qty) OVER k AS b_total
FROM (SELECT brand, region, week_no, qty FROM v_weekly) a
FULL JOIN (SELECT brand, region, week_no, qty FROM v_weekly_secondary) b USING (brand, region, week_no)
WINDOW k AS (PARTITION BY brand, region)
""")
def fact_consistency(t):
    return ops.fact_consistency(t.weekly, t.weekly_secondary, [*KEYS, "week_no"], KEYS, "qty")


_MEDIAN = f"""(SELECT *, quantile_cont(qty, 0.5) OVER ({_S} RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING) AS med
              FROM v_weekly) m"""


def _with_median(t):
    spec = Window.partitionBy(*KEYS).orderBy("week_no").rangeBetween(-8, -1)
    return t.weekly.select(*KEYS, "week_no", "qty", F.percentile("qty", 0.5).over(spec).alias("med"))


@query("dq13_outlier_grid", f"""
SELECT CAST(floor_at AS INTEGER) AS threshold, CAST(factor AS INTEGER) AS multiplier,
       count(*) FILTER (WHERE qty / greatest(coalesce(med, floor_at), floor_at) >= factor) / count(*) AS record_share,
       sum(qty) FILTER (WHERE qty / greatest(coalesce(med, floor_at), floor_at) >= factor) / sum(qty) AS volume_share
FROM {_MEDIAN}, unnest([1, 2, 3, 4]) a(floor_at), unnest([2, 3, 4, 5]) b(factor) GROUP BY floor_at, factor
""")
def outlier_grid(t):
    return ops.outlier_grid(_with_median(t), "qty", "med", [1, 2, 3, 4], [2, 3, 4, 5])


@query("dq14_peak_flag", f"""
SELECT brand, region, week_no, qty, coalesce(qty / greatest(coalesce(med, 2), 2) >= 3, FALSE) AS is_outlier FROM {_MEDIAN}
""")
def peak_flag(t):
    return _with_median(t).select(*KEYS, "week_no", "qty", ops.flag_peak("qty", "med").alias("is_outlier"))


@query("dq15_membership_gap", """
WITH a AS (SELECT site, product FROM v_lines WHERE return_flag = 'R'), b AS (SELECT site, product FROM v_sales WHERE return_flag <> 'R'),
x AS (SELECT a.site, b.site IS NULL AS outside FROM a LEFT JOIN (SELECT DISTINCT site, product FROM b) b USING (site, product)),
y AS (SELECT b.site, a.site IS NULL AS outside FROM b LEFT JOIN (SELECT DISTINCT site, product FROM a) a USING (site, product))
SELECT 'first' AS fact, count(*) AS rows, count(*) FILTER (WHERE outside) AS outside_rows,
       count(*) FILTER (WHERE outside) / count(*) AS outside_share FROM x
UNION ALL SELECT 'second', count(*), count(*) FILTER (WHERE outside), count(*) FILTER (WHERE outside) / count(*) FROM y
""")
def membership_gap(t):
    """Returns against sell-out: products of a site that only one of the two facts knows."""
    returned = t.primary_lines.where("return_flag = 'R'")
    return ops.membership_gap(returned, t.sales.where("return_flag <> 'R'"), ["site", "product"])


@query("dq15_incomplete_months", """
SELECT brand, region, CAST(date_trunc('month', week) AS DATE) AS month, count(*) AS weeks FROM v_weekly
GROUP BY 1, 2, 3 HAVING count(*) <= 3
""")
def incomplete_months(t):
    return ops.incomplete_months(t.weekly, KEYS, "week")
