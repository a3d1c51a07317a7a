"""Queries: promotion analytics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window, functions as F

from aisle.functions import weeks
from aisle.operators import promotion as ops, timeseries as ts
from aisle.plans.registry import query
from aisle.session import checkpointed

_SERIES = "category, dp, material"
_RUN = "category, dp, material, run_no"


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("prm01_promo_weeks", """
SELECT product, CAST(date_trunc('week', d) AS DATE) AS week, count(DISTINCT scheme) AS schemes, count(*) AS scheme_days,
       max(discount) AS max_discount, round(avg(discount), 9) AS mean_discount
FROM v_promotions, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) u(d)
GROUP BY 1, 2
""")
def promo_weeks(t):
    return _r(ops.promo_weeks(t.promotions, ["product"]), 9, "mean_discount")


_LINES = """(SELECT CAST(isoyear(x.date) * 100 + weekofyear(x.date) AS INTEGER) AS yearweek, p.brand, x.return_flag AS kind,
             x.invoice AS scheme, x.discount FROM v_lines x JOIN v_products p ON x.product = p.product) l"""


def _promo_lines(t):
    return t.primary_lines.join(t.products.select("product", "brand"), "product").select(
        weeks.iso_yearweek("date").alias("yearweek"), "brand", F.col("return_flag").alias("kind"),
        F.col("invoice").alias("scheme"), "discount", "date")


@query("prm02_scheme_types", f"""
SELECT *, concat_ws('_', scheme_type, kind) AS promotion_type FROM (
  SELECT yearweek, brand, kind, count(DISTINCT scheme) AS scheme_unique_count, count(*) AS scheme_count,
         CASE WHEN count(DISTINCT scheme) = 1 AND count(*) = 1 THEN 'SINGLE' WHEN count(DISTINCT scheme) = 1 THEN 'PROGRESSIVE'
              WHEN count(DISTINCT scheme) < count(*) THEN 'HYBRID' ELSE 'ON_TOP' END AS scheme_type
  FROM {_LINES} GROUP BY 1, 2, 3) x
""")
def scheme_types(t):
    return ops.scheme_types(_promo_lines(t), ["yearweek", "brand"], "kind", "scheme")


@query("prm03_feature_matrix", """
SELECT yearweek, brand, count(*) AS promotions,
       count(DISTINCT CASE WHEN week_type = 'HOLIDAY' THEN scheme END) AS week_type_1,
       count(DISTINCT CASE WHEN week_type = 'NORMAL' THEN scheme END) AS week_type_2,
       count(*) FILTER (WHERE kind = '1-URGENT') AS kind_1, count(*) FILTER (WHERE kind = '2-HIGH') AS kind_2,
       count(DISTINCT CASE WHEN buy = 'F' THEN scheme END) AS buy_1, count(DISTINCT CASE WHEN buy = 'O' THEN scheme END) AS buy_2,
       count(DISTINCT CASE WHEN buy = 'P' THEN scheme END) AS buy_3, min(discount) AS discount_min,
       max(discount) AS discount_max, round(avg(discount), 9) AS discount_mean,
       max(CASE WHEN strftime(start_date, '%m%d') IN ('0101', '0430', '0501', '0902') THEN 1 ELSE 0 END) AS holiday
FROM (SELECT CAST(isoyear(start_date) * 100 + weekofyear(start_date) AS INTEGER) AS yearweek, p.brand, mechanic AS kind,
             status AS buy, scheme, discount, start_date, CASE WHEN c.working_days < 6 THEN 'HOLIDAY' ELSE 'NORMAL' END AS week_type
      FROM v_promotions x JOIN v_products p ON x.product = p.product
      JOIN v_full_weeks c ON c.week = CAST(date_trunc('week', start_date) AS DATE)) z
GROUP BY 1, 2
""")
def feature_matrix(t):
    posts = t.promotions.join(t.products.select("product", "brand"), "product").select(
        weeks.iso_yearweek("start_date").alias("yearweek"), "brand", F.col("mechanic").alias("kind"),
        F.col("status").alias("buy"), "scheme", "discount",
        F.date_format("start_date", "MMdd").isin(*weeks.HOLIDAYS).alias("holiday"),
        F.when(weeks.working_days(weeks.week_start("start_date")) < 6, "HOLIDAY").otherwise("NORMAL").alias("week_type"))
    out = ops.feature_matrix(posts, ["yearweek", "brand"])
    return _r(out, 9, "discount_mean")


@query("prm04_investment_counts", f"""
SELECT yearweek, brand, CAST(sum(a) AS BIGINT) AS type_1, CAST(sum(n) AS BIGINT) AS type_2, CAST(sum(o) AS BIGINT) AS type_other
FROM (SELECT yearweek, brand, scheme, max(CASE WHEN kind = 'A' THEN 1 ELSE 0 END) AS a,
             max(CASE WHEN kind = 'N' THEN 1 ELSE 0 END) AS n, max(CASE WHEN kind NOT IN ('A', 'N') THEN 1 ELSE 0 END) AS o
      FROM {_LINES} GROUP BY 1, 2, 3) x GROUP BY 1, 2
""")
def investment_counts(t):
    return ops.investment_counts(_promo_lines(t), ["yearweek", "brand"], "scheme", "kind", ["A", "N"])


_GIFT = "gift_qty * CASE gift_uom WHEN 'SU' THEN gift_price_su WHEN 'CS' THEN gift_price_cs ELSE gift_price_pc END"


@query("prm05_benefit", f"""
SELECT scheme, CASE WHEN mechanic_type = 'PERCENTAGE' THEN pct_discount * min_buy
            * CASE min_buy_uom WHEN 'VND' THEN 1.0::DOUBLE WHEN 'SU' THEN price_su WHEN 'CS' THEN price_cs ELSE price_pc END / 100
            WHEN mechanic_type = 'VALUE' THEN val_discount ELSE {_GIFT} END AS benefit,
       CASE WHEN mechanic_type = 'PERCENTAGE' THEN pct_discount / min_buy * CASE WHEN min_buy_uom = 'VND' THEN 1000 ELSE 1 END
            WHEN mechanic_type = 'VALUE' THEN val_discount / min_buy
            ELSE {_GIFT} / min_buy * CASE WHEN min_buy_uom = 'VND' THEN 1000 ELSE 1 END END AS benefit_per_min_buy
FROM v_deals
""")
def benefit(t):
    return t.deals.select("scheme", *ops.benefit())


@query("prm06_effective_deals", """
SELECT scheme, deal_status, CAST(strptime(CAST(start_date AS VARCHAR), '%Y%m%d') AS DATE) AS start,
       CAST(strptime(CAST(CASE WHEN stop_date <> 0 THEN stop_date ELSE orig_end_date END AS VARCHAR), '%Y%m%d') AS DATE) AS "end"
FROM v_deals
WHERE deal_status <> 'CANCELLED' AND CASE WHEN stop_date <> 0 THEN stop_date ELSE orig_end_date END >= start_date
""")
def effective_deals(t):
    return ops.effective_deals(t.deals, ["CANCELLED", "INACTIVE"]).select("scheme", "deal_status", "start", "end")


@query("prm07_banded_correction", """
WITH m AS (SELECT category, dp, material, week, pri_sales AS sales,
                  CASE WHEN material IN ('PROMO', 'SMALL') AND sec_sales > 0 THEN sec_sales END AS banded_sales,
                  CASE material WHEN 'PROMO' THEN 'STANDARD' WHEN 'SMALL' THEN 'LARGE' END AS base FROM v_banded),
w AS (SELECT *, max(base) OVER k AS base_material, sum(banded_sales) OVER k AS banded FROM m
      WINDOW k AS (PARTITION BY category, dp, week))
SELECT category, dp, material, week, sales, banded_sales, CASE WHEN material = base_material AND banded > 0
       THEN coalesce(banded_sales, sales) - banded ELSE coalesce(banded_sales, sales) END AS sales_corrected
FROM w
""")
def banded_correction(t):
    material = F.col("material")
    is_banded = material.isin("PROMO", "SMALL") & (F.col("sec_sales") > 0)
    frame = t.banded.select(
        "category", "dp", "material", "week", F.col("pri_sales").alias("sales"),
        F.when(is_banded, F.col("sec_sales")).alias("banded_sales"))
    base = F.when(material == "PROMO", "STANDARD").when(material == "SMALL", "LARGE")
    bom = t.products.select(F.col("category").alias("material")).distinct().select(
        "material", base.alias("base_material")).where("base_material is not null")
    return ops.banded_correction(frame, bom)


def _runs_sql(source, name, run):
    s = f"PARTITION BY {_SERIES} ORDER BY week_no"
    return f"""
{name}_o AS (SELECT *, CASE WHEN coalesce(week_no - lag(week_no) OVER ({s}), 0) > 2 OR
                 coalesce(sum(pri_sales) OVER ({s} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS opens
          FROM {source}),
{name} AS (SELECT * EXCLUDE (opens), CAST(sum(opens) OVER ({s} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS {run}
        FROM {name}_o)"""


_UPLIFT = f"""{_runs_sql('v_banded', 'b1', 'run0')},
up AS (SELECT category, dp, material, week, week_no, CASE WHEN sum(pri_sales) OVER (PARTITION BY {_SERIES}, run0)
              / nullif(sum(pri_sales) OVER (PARTITION BY {_SERIES}), 0) < 0.01 THEN 0 ELSE pri_sales END AS pri_sales,
              sec_sales, pri_sales_dp, baseline, CASE WHEN pri_sales_dp = 0 THEN 0 ELSE pri_sales / pri_sales_dp END AS contribution,
              pri_sales_dp - baseline AS uplift FROM b1)"""


@query("prm08_uplift", f"WITH {_UPLIFT} SELECT category, dp, material, week, pri_sales, contribution, uplift FROM up")
def uplift(t):
    return ops.uplift(t.banded).select("category", "dp", "material", "week", "pri_sales", "contribution", "uplift")


_RUNS = f"{_UPLIFT},{_runs_sql('up', 'rn', 'run_no')}"


@query("prm09_runs", f"WITH {_RUNS} SELECT category, dp, material, week, pri_sales, run_no FROM rn")
def runs(t):
    return ops.numbered_runs(ops.uplift(t.banded)).select("category", "dp", "material", "week", "pri_sales", "run_no")


_W = f"PARTITION BY {_RUN} ORDER BY week_no"
_CUM = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PRELOAD = f"""{_RUNS},
pa AS (SELECT *, row_number() OVER ({_W}) AS pos, sum(pri_sales) OVER {_CUM} AS cum_pri, sum(sec_sales) OVER {_CUM} AS cum_sec,
              sum(pri_sales) OVER (PARTITION BY {_RUN}) AS total FROM rn),
pb AS (SELECT *, coalesce(cum_pri / nullif(total, 0), 0) AS cum_share,
              min(pos) FILTER (WHERE total > 0 AND cum_pri * 10 >= total * 9) OVER (PARTITION BY {_RUN}) AS stop FROM pa),
pre AS (SELECT *, CASE WHEN pos <= stop THEN uplift ELSE 0 END AS preload_volume,
               CAST(CASE WHEN pos <= stop THEN stop ELSE 0 END AS INTEGER) AS preload_length,
               CASE WHEN pos <= stop THEN min(week) OVER (PARTITION BY {_RUN}) END AS preload_start,
               CASE WHEN pos <= stop THEN max(week) FILTER (WHERE pos <= stop) OVER (PARTITION BY {_RUN}) END AS preload_end,
               max(cum_pri) FILTER (WHERE pos <= stop) OVER (PARTITION BY {_RUN}) AS preload_sum
        FROM pb WHERE stop IS NOT NULL)"""


def _preload(t):
    return ops.preload(ops.numbered_runs(ops.uplift(t.banded)))


@query("prm10_preload", f"""
WITH {_PRELOAD} SELECT category, dp, material, week, run_no, preload_volume, preload_length, preload_start, preload_end,
       preload_sum FROM pre
""")
def preload(t):
    return _preload(t).select(
        "category", "dp", "material", "week", "run_no", "preload_volume", "preload_length", "preload_start", "preload_end",
        "preload_sum")


def _shift_sql(source, name, keep):
    k = f"PARTITION BY {_RUN}, preload_length > 0"
    return f"""
{name}_a AS (SELECT *, row_number() OVER ({k} ORDER BY week_no) - 1 AS idx, {keep} AS ok FROM {source}),
{name}_b AS (SELECT *, CASE WHEN preload_length > 0 THEN coalesce(min(idx) FILTER (WHERE ok) OVER ({k}), max(idx) OVER ({k}))
                    ELSE 0 END AS goal FROM {name}_a),
{name}_c AS (SELECT *, preload_length > 0 AND idx < goal AS early, preload_length > 0 AND idx = goal AS here FROM {name}_b),
{name}_d AS (SELECT *, coalesce(sum(pri_sales) FILTER (WHERE early) OVER ({k}), 0) AS mp,
                  coalesce(sum(sec_sales) FILTER (WHERE early) OVER ({k}), 0) AS ms FROM {name}_c),
{name} AS (SELECT category, dp, material, week, week_no, run_no, pri_sales_dp, baseline, contribution, uplift, cum_share, cum_sec,
               preload_sum, CASE WHEN early THEN 0 WHEN here THEN pri_sales + mp ELSE pri_sales END AS pri_sales,
               CASE WHEN early THEN 0 WHEN here THEN sec_sales + ms ELSE sec_sales END AS sec_sales,
               CASE WHEN early THEN 0 WHEN preload_length > 0 THEN preload_length - goal ELSE 0 END AS preload_length,
               CASE WHEN early THEN 0 ELSE preload_volume END AS preload_volume FROM {name}_d)"""


_SHIFT = f"{_PRELOAD},{_shift_sql('pre', 'sh1', 'uplift >= 0')},{_shift_sql('sh1', 'sh2', 'cum_share >= 0.05')}"


@query("prm11_shift_preload", f"""
WITH {_SHIFT} SELECT category, dp, material, week, run_no, pri_sales, sec_sales, CAST(preload_length AS BIGINT) AS preload_length,
       preload_volume FROM sh2
""")
def shift_preload(t):
    out = ops.shift_preload(_preload(t)).withColumn("preload_length", F.col("preload_length").cast("bigint"))
    return out.select(
        "category", "dp", "material", "week", "run_no", "pri_sales", "sec_sales", "preload_length", "preload_volume")


_POST = f"""{_SHIFT},
po_a AS (SELECT *, row_number() OVER ({_W}) AS pos, max(preload_length) OVER (PARTITION BY {_RUN}) AS pl
         FROM sh2 WHERE NOT (pri_sales = 0 AND sec_sales = 0)),
po_b AS (SELECT *, min(pos) FILTER (WHERE cum_sec >= preload_sum) OVER (PARTITION BY {_RUN}) AS stop FROM po_a),
po AS (SELECT *, CASE WHEN preload_length > 0 THEN 0 WHEN pos <= stop THEN stop - pl END AS postload_length,
              CASE WHEN preload_length > 0 THEN 0 WHEN pos <= stop THEN uplift ELSE 0 END AS postload_volume FROM po_b)"""


def _postload(t):
    return ops.postload(ops.shift_preload(_preload(t)))


@query("prm12_postload", f"""
WITH {_POST} SELECT category, dp, material, week, run_no, CAST(preload_length AS BIGINT) AS preload_length,
       CAST(postload_length AS BIGINT) AS postload_length, postload_volume FROM po
""")
def postload(t):
    out = _postload(t)
    return out.select(
        "category", "dp", "material", "week", "run_no", F.col("preload_length").cast("bigint").alias("preload_length"),
        F.col("postload_length").cast("bigint").alias("postload_length"), "postload_volume")


_K = "(PARTITION BY category, dp, week_no)"
_OVERLAP = f"""{_POST},
ov_a AS (SELECT * EXCLUDE (postload_volume), CASE WHEN sum(preload_volume) OVER {_K} <> 0 AND sum(postload_volume) OVER {_K} <> 0
                THEN 0 ELSE postload_volume END AS postload_volume FROM po),
ov_b AS (SELECT *, coalesce(sum(preload_volume) OVER {_K} = max(preload_volume) FILTER (WHERE preload_volume <> 0) OVER {_K}, FALSE) AS one,
                coalesce(sum(postload_volume) OVER {_K} = max(postload_volume) FILTER (WHERE postload_volume <> 0) OVER {_K}, FALSE) AS two
         FROM ov_a),
ov AS (SELECT * EXCLUDE (preload_volume, postload_volume),
              CASE WHEN one THEN preload_volume ELSE preload_volume * contribution END AS preload_volume,
              CASE WHEN two THEN postload_volume ELSE postload_volume * contribution END AS postload_volume
       FROM ov_b WHERE preload_length > 0 OR postload_length > 0)"""


def _resolved(t):
    return ops.resolve_overlaps(_postload(t))


@query("prm13_overlaps", f"""
WITH {_OVERLAP} SELECT category, dp, material, week, run_no, preload_volume, postload_volume FROM ov
""")
def overlaps(t):
    return _resolved(t).select("category", "dp", "material", "week", "run_no", "preload_volume", "postload_volume")


def _part_sql(n):
    test = f"{n}_length > 0"
    run = f"OVER (PARTITION BY {_RUN})"
    return f"""coalesce(sum(baseline) FILTER (WHERE {test}) {run}, 0) AS {n}_base, sum({n}_volume) {run} AS {n}_total,
       CASE WHEN {test} THEN coalesce(pri_sales_dp / nullif(sum(pri_sales_dp) FILTER (WHERE {test}) {run}, 0), 0) ELSE 0 END
       AS {n}_weekly"""


_RATIOS = f"""{_OVERLAP},
ra_a AS (SELECT *, {_part_sql('preload')}, {_part_sql('postload')} FROM ov WHERE postload_length IS NOT NULL),
ra AS (SELECT *, CASE WHEN preload_base = 0 THEN 0 ELSE preload_total / preload_base END AS preload_ratio,
              CASE WHEN postload_base = 0 THEN 0 ELSE postload_total / postload_base END AS postload_ratio,
              (preload_total + postload_total) / nullif(preload_base + postload_base, 0) AS uplift_ratio FROM ra_a)"""


def _ratios(t):
    return ops.uplift_ratios(_resolved(t))


def _curve_sql(part):
    return f"""
{part}_l AS (SELECT category, dp, {part}_length AS v, count(*) AS n FROM (SELECT DISTINCT {_RUN}, {part}_length FROM ra
           WHERE {part}_length > 0) x GROUP BY 1, 2, 3),
{part}_m AS (SELECT category, dp, coalesce(quantile_disc(v, 0.5) FILTER (WHERE v <> 1), 1) AS mode FROM {part}_l
           WHERE (category, dp, n) IN (SELECT (category, dp, max(n)) FROM {part}_l GROUP BY category, dp) GROUP BY 1, 2),
{part}_p AS (SELECT ra.*, row_number() OVER ({_W}) AS position FROM ra JOIN {part}_m USING (category, dp)
           WHERE {part}_length = mode),
{part}_s AS (SELECT category, dp, position, avg({part}_weekly) AS a, quantile_cont({part}_weekly, 0.5) AS m FROM {part}_p GROUP BY 1, 2, 3),
{part}_c AS (SELECT category, dp, '{part.upper()}' AS type, CAST(position AS INTEGER) AS position,
                  coalesce(a / nullif(sum(a) OVER k, 0), 0) AS phasing_mean, coalesce(m / nullif(sum(m) OVER k, 0), 0) AS phasing_median
           FROM {part}_s WINDOW k AS (PARTITION BY category, dp))"""


_CURVES = f"""{_RATIOS},{_curve_sql('preload')},{_curve_sql('postload')},
curve AS (SELECT * FROM preload_c UNION ALL SELECT * FROM postload_c)"""


@query("prm14_phasing_curve", f"""
WITH {_CURVES} SELECT category, dp, type, position, round(phasing_mean, 9) AS phasing_mean,
       round(phasing_median, 9) AS phasing_median FROM curve
""")
def phasing_curve(t):
    ratios = checkpointed(_ratios(t))
    out = ops.phasing_curve(ratios, "preload").unionByName(ops.phasing_curve(ratios, "postload"))
    return _r(out, 9, "phasing_mean", "phasing_median")


@query("prm15_uplift_ratios", f"""
WITH {_RATIOS} SELECT category, dp, material, week, run_no, round(preload_ratio, 8) AS preload_ratio,
       round(postload_ratio, 8) AS postload_ratio, round(uplift_ratio, 8) AS uplift_ratio,
       round(preload_weekly, 9) AS preload_weekly, round(postload_weekly, 9) AS postload_weekly FROM ra
""")
def uplift_ratios(t):
    out = _ratios(t).select(
        "category", "dp", "material", "week", "run_no", "preload_ratio", "postload_ratio", "uplift_ratio",
        "preload_weekly", "postload_weekly")
    return _r(_r(out, 8, "preload_ratio", "postload_ratio", "uplift_ratio"), 9, "preload_weekly", "postload_weekly")


_APPLIED = f"""{_CURVES},
vol AS (SELECT category, dp, avg(preload_ratio) AS pm, quantile_cont(preload_ratio, 0.5) AS pd, avg(postload_ratio) AS qm,
               quantile_cont(postload_ratio, 0.5) AS qd
        FROM (SELECT DISTINCT {_RUN}, preload_ratio, postload_ratio FROM ra) x GROUP BY 1, 2),
st AS (SELECT DISTINCT s.region AS category, p.brand AS dp, CASE WHEN isodow(x.start_date) = 7 THEN x.start_date + 1
              ELSE x.start_date END AS start_date
       FROM (SELECT start_date, product, outlet FROM v_promotions WHERE start_date > DATE '2001-06-01') x
       JOIN v_products p ON x.product = p.product
       JOIN (SELECT o.outlet, r_name AS region FROM v_outlets o JOIN nation ON nation_key = n_nationkey
             JOIN region ON n_regionkey = r_regionkey) s ON x.outlet = s.outlet),
app AS (SELECT st.category, st.dp, st.start_date, c.type, c.position,
               CAST(date_trunc('week', st.start_date + (c.position - 1) * 7) AS DATE) AS week,
               c.phasing_mean * CASE WHEN c.type = 'PRELOAD' THEN pm ELSE qm END AS volume_mean,
               c.phasing_median * CASE WHEN c.type = 'PRELOAD' THEN pd ELSE qd END AS volume_median
        FROM st JOIN curve c ON st.category = c.category AND st.dp = c.dp JOIN vol v ON st.category = v.category AND st.dp = v.dp)"""


def _starts(t):
    regions = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_custkey").alias("outlet"), F.col("r_name").alias("category"))
    posts = t.promotions.select("start_date", "product", "outlet").join(
        t.products.select("product", F.col("brand").alias("dp")), "product").join(regions, "outlet")
    return ops.future_starts(posts, date(2001, 6, 1))


def _applied(t):
    # The curves and volumes read the chain's result five times.
    ratios = checkpointed(_ratios(t))
    curve = ops.phasing_curve(ratios, "preload").unionByName(ops.phasing_curve(ratios, "postload"))
    return ops.apply_curve(curve, ops.run_volumes(ratios), _starts(t))


@query("prm16_apply_curve", f"""
WITH {_APPLIED} SELECT category, dp, start_date, type, position, week, CAST(isoyear(week) * 100 + weekofyear(week) AS INTEGER)
       AS yearweek, round(volume_mean, 8) AS volume_mean, round(volume_median, 8) AS volume_median FROM app
""")
def apply_curve(t):
    return _r(_applied(t), 8, "volume_mean", "volume_median")


@query("prm17_impact_class", """
SELECT scheme, CASE WHEN contains(txt, 'discount') AND contains(txt, 'gift') THEN 'gift+price' WHEN contains(txt, 'gift') THEN 'gift'
       WHEN contains(txt, 'discount') THEN 'price' ELSE '0' END AS impact, CAST(discount >= 0.09 AS INTEGER) AS special_event
FROM (SELECT scheme, discount, concat_ws(' ', CASE WHEN mechanic = '1-URGENT' THEN 'discount' ELSE 'post' END,
             CASE status WHEN 'F' THEN 'gift' WHEN 'O' THEN 'normal' END) AS txt FROM v_promotions) x
""")
def impact_class(t):
    text = F.concat_ws(
        " ", F.when(F.col("mechanic") == "1-URGENT", "discount").otherwise("post"),
        F.when(F.col("status") == "F", "gift").when(F.col("status") == "O", "normal"))
    return t.promotions.select(
        "scheme", ops.impact_class(text).alias("impact"), (F.col("discount") >= 0.09).cast("int").alias("special_event"))


@query("prm18_post_mart", """
SELECT brand, year, kind, min(date) AS start_date, max(date) AS end_date, count(*) AS days, sum(qty) AS qty,
       round(avg(discount), 8) AS discount_mean
FROM (SELECT p.brand, CAST(year(x.date) AS INTEGER) AS year, x.return_flag AS kind, x.date, sum(x.qty) AS qty,
             max(x.discount) AS discount FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY 1, 2, 3, 4) d
GROUP BY 1, 2, 3
""")
def post_mart(t):
    daily = t.primary_lines.join(t.products.select("product", "brand"), "product").groupBy(
        "brand", F.year("date").alias("year"), F.col("return_flag").alias("kind"), "date").agg(
        F.sum("qty").alias("qty"), F.max("discount").alias("discount"))
    return _r(ops.post_mart(daily, ["brand", "year", "kind"], ["qty"], ["discount"]), 8, "discount_mean")


_LEVEL = """(SELECT *, quantile_cont(qty, 0.5) OVER (PARTITION BY brand, region) AS base FROM v_weekly) b"""


def _with_level(t):
    return t.weekly.withColumn("base", F.percentile("qty", 0.5).over(Window.partitionBy("brand", "region")))


@query("prm19_uplift_classes", f"""
SELECT brand, region, yearweek, qty - base AS abs_uplift, (qty - base) / base AS pct_uplift,
       CAST(qty - base >= 0 AS INTEGER) AS uplift_class
FROM {_LEVEL} WHERE (qty - base) / base BETWEEN -1 AND 1 OR yearweek > 200026
""")
def uplift_classes(t):
    out = ops.uplift_classes(_with_level(t), "qty", "base", F.col("yearweek") <= 200026)
    return out.select("brand", "region", "yearweek", "abs_uplift", "pct_uplift", "uplift_class")


@query("prm20_transform_uplift", f"""
WITH f AS (SELECT *, (qty - base) / base AS pct, CAST(promo_qty > 0 AS INTEGER) AS sign,
                  count(*) OVER (PARTITION BY brand, region, date_trunc('month', week + 3)) AS cw,
                  row_number() OVER (PARTITION BY brand, region, date_trunc('month', week + 3) ORDER BY week) AS wo FROM {_LEVEL}),
m AS (SELECT brand, region, cw, wo, sign, quantile_cont(pct, 0.5) AS med FROM f WHERE yearweek <= 200026 AND cw >= 4 GROUP BY ALL)
SELECT f.brand, f.region, f.yearweek, round(coalesce(m.med, 0) * f.base, 6) AS predicted_uplift
FROM f LEFT JOIN m ON f.brand = m.brand AND f.region = m.region AND f.cw = m.cw AND f.wo = m.wo AND f.sign = m.sign
""")
def transform_uplift(t):
    frame = _with_level(t).select(
        "*", ((F.col("qty") - F.col("base")) / F.col("base")).alias("pct"),
        (F.col("promo_qty") > 0).cast("int").alias("sign"), F.date_add("week", 3).alias("anchor"))
    placed = ts.month_position(frame, ["brand", "region"], "anchor", "week")
    out = ops.transform_uplift(placed, ["brand", "region"], "sign", "pct", "base", F.col("yearweek") <= 200026)
    return _r(out.select("brand", "region", "yearweek", "predicted_uplift"), 6, "predicted_uplift")


@query("prm21_collapse_lines", """
WITH m AS (SELECT p.brand, p.category, mechanic, discount, min(start_date) AS start_date, max(end_date) AS end_date,
                  avg(p.price) AS price FROM v_promotions x JOIN v_products p ON x.product = p.product GROUP BY 1, 2, 3, 4)
SELECT brand, category, start_date, end_date, min(mechanic) AS mechanic,
       arg_min(discount, row(mechanic, discount)) AS discount, round(avg(price), 8) AS price
FROM m GROUP BY 1, 2, 3, 4
""")
def collapse_lines(t):
    lines = t.promotions.join(t.products, "product")
    return _r(ops.collapse_lines(lines, ["brand", "category"], ["mechanic", "discount"], "price"), 8, "price")


@query("prm22_total_forecast", f"""
WITH {_APPLIED},
base AS (SELECT region AS category, brand AS dp, week, qty AS forecast FROM v_weekly WHERE week >= DATE '2001-01-01'),
j AS (SELECT a.category, a.dp, a.week, sum(b.forecast) OVER (PARTITION BY a.category, a.dp, a.start_date, a.type) * a.volume_mean AS x,
             sum(b.forecast) OVER (PARTITION BY a.category, a.dp, a.start_date, a.type) * a.volume_median AS y
      FROM app a JOIN base b ON a.category = b.category AND a.dp = b.dp AND a.week = b.week),
g AS (SELECT category, dp, week, sum(x) AS x, sum(y) AS y FROM j GROUP BY 1, 2, 3)
SELECT base.category, base.dp, base.week, base.forecast, round(base.forecast + coalesce(g.x, 0), 6) AS total_mean,
       round(base.forecast + coalesce(g.y, 0), 6) AS total_median
FROM base LEFT JOIN g ON base.category = g.category AND base.dp = g.dp AND base.week = g.week
""")
def total_forecast(t):
    base = t.weekly.where(F.col("week") >= F.lit(date(2001, 1, 1))).select(
        F.col("region").alias("category"), F.col("brand").alias("dp"), "week", F.col("qty").alias("forecast"))
    return _r(ops.total_forecast(base, _applied(t)), 6, "total_mean", "total_median")


@query("prm23_without_banded", f"""
WITH {_OVERLAP},
k AS (SELECT category, dp, week, sum(preload_volume + postload_volume) AS u, count(*) AS n FROM ov
      WHERE contribution BETWEEN -2 AND 2 GROUP BY 1, 2, 3)
SELECT w.region AS category, w.brand AS dp, w.week, w.qty AS sales, round(coalesce(k.u, 0), 8) AS uplift_banded,
       coalesce(k.n, 0) AS banded_count, round(w.qty - coalesce(k.u, 0), 8) AS sales_without_banded
FROM v_weekly w LEFT JOIN k ON w.region = k.category AND w.brand = k.dp AND w.week = k.week
""")
def without_banded(t):
    sales = t.weekly.select(
        F.col("region").alias("category"), F.col("brand").alias("dp"), "week", F.col("qty").alias("sales"))
    out = ops.without_banded(sales, _resolved(t), ["category", "dp", "week"])
    return _r(out, 8, "uplift_banded", "sales_without_banded")
