"""Queries: aggregations, ranking and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from aisle.functions.weeks import iso_yearweek
from aisle.operators import aggregates as ops, ordering, ranking
from aisle.plans.registry import query

KEYS = ["brand", "region"]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("agg01_group_sums", """
SELECT region, brand, yearweek, sum(qty) AS qty, round(sum(gsv), 4) AS gsv, CAST(sum(lines) AS BIGINT) AS lines
FROM v_weekly GROUP BY 1, 2, 3
""")
def group_sums(t):
    return t.weekly.groupBy("region", "brand", "yearweek").agg(
        F.sum("qty").alias("qty"), F.round(F.sum("gsv"), 4).alias("gsv"), F.sum("lines").alias("lines"))


@query("agg02_distinct_counts", """
SELECT r.region, o.channel, count(DISTINCT x.outlet) AS eco, count(DISTINCT x.product) AS assortment,
       count(DISTINCT x.site) AS sites
FROM v_sales x JOIN v_sites r ON x.site = r.site JOIN v_outlets o ON x.outlet = o.outlet GROUP BY 1, 2
""")
def distinct_counts(t):
    return (
        t.sales.select("site", "outlet", "product").join(t.sites.select("site", "region"), "site")
        .join(t.outlets.select("outlet", "channel"), "outlet").groupBy("region", "channel")
        .agg(F.count_distinct("outlet").alias("eco"), F.count_distinct("product").alias("assortment"),
             F.count_distinct("site").alias("sites"))
    )


@query("agg03_conditional_sums", """
SELECT site, sum(CASE WHEN status = 'F' THEN qty ELSE 0 END) AS delivered_qty,
       count(*) FILTER (WHERE status = 'O') AS open_lines,
       count(DISTINCT CASE WHEN status = 'P' THEN invoice END) AS pending_invoices
FROM v_sales GROUP BY site
""")
def conditional_sums(t):
    status = F.col("status")
    return t.sales.groupBy("site").agg(
        F.sum(F.when(status == "F", F.col("qty")).otherwise(0.0)).alias("delivered_qty"),
        F.count_if(status == "O").alias("open_lines"),
        F.count_distinct(F.when(status == "P", F.col("invoice"))).alias("pending_invoices"))


@query("agg04_describe_series", """
SELECT brand, region, count(DISTINCT yearweek) AS n_periods, min(yearweek) AS first_period,
       max(yearweek) AS last_period, sum(qty) AS total, avg(qty) AS mean, max(qty) AS highest, min(qty) AS lowest
FROM v_weekly GROUP BY 1, 2
""")
def describe_series(t):
    return ops.describe_by(t.weekly, KEYS, "yearweek", "qty")


@query("agg05_presence_then_count", """
SELECT yearweek, CAST(sum(urgent) AS BIGINT) AS urgent, CAST(sum(deep) AS BIGINT) AS deep
FROM (SELECT CAST(isoyear(start_date) * 100 + weekofyear(start_date) AS INTEGER) AS yearweek, scheme,
             max(CASE WHEN mechanic = '1-URGENT' THEN 1 ELSE 0 END) AS urgent,
             max(CASE WHEN discount >= 0.08 THEN 1 ELSE 0 END) AS deep FROM v_promotions GROUP BY 1, 2) x GROUP BY 1
""")
def presence_then_count(t):
    posts = t.promotions.select("scheme", "mechanic", "discount", iso_yearweek("start_date").alias("yearweek"))
    flags = {"urgent": F.col("mechanic") == "1-URGENT", "deep": F.col("discount") >= 0.08}
    return ops.presence_then_count(posts, "scheme", ["yearweek"], flags)


@query("agg06_collapse_rows", """
SELECT o_custkey, min(o_orderstatus) AS first_status, arg_min(o_orderpriority, row(o_orderdate, o_orderkey))
       AS first_priority, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best_delivered
FROM orders GROUP BY 1
""")
def collapse_rows(t):
    earliest = F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority"))
    return t.orders.groupBy("o_custkey").agg(
        F.min("o_orderstatus").alias("first_status"), earliest["o_orderpriority"].alias("first_priority"),
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("best_delivered"))


@query("agg07_concat_values", """
SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, max(p_name) AS last_name,
       count(DISTINCT p_name) AS names
FROM part GROUP BY 1
""")
def concat_values(t):
    return t.part.groupBy("p_brand").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("p_type"))).alias("types"),
        F.max("p_name").alias("last_name"), F.count_distinct("p_name").alias("names"))


@query("agg08_value_or_default", """
SELECT o_custkey, coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000
                               THEN o_orderstatus END), 'none') AS urgent_status
FROM orders GROUP BY 1
""")
def value_or_default(t):
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)
    return t.orders.groupBy("o_custkey").agg(
        F.coalesce(F.max(F.when(urgent, F.col("o_orderstatus"))), F.lit("none")).alias("urgent_status"))


@query("agg09_pivot_sum", "SELECT region, " + ", ".join(
    f"""sum(CASE WHEN priority = '{p}' THEN qty ELSE 0 END) AS qty_{p.lower().replace(' ', '_').replace('-', '_')}"""
    for p in _PRIORITIES) + " FROM v_sales x JOIN v_sites s ON x.site = s.site GROUP BY 1")
def pivot_sum(t):
    lines = t.sales.select("site", "priority", "qty").join(t.sites.select("site", "region"), "site")
    return ops.pivot_sum(lines, ["region"], "priority", F.col("qty"), "qty_")


_DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


@query("agg10_weekday_pivot", """
WITH w AS (SELECT brand, CAST(date_trunc('week', date) AS DATE) AS week, """ + ", ".join(
    f"sum(CASE WHEN isodow(date) = {i} THEN qty ELSE 0 END) AS {n}" for i, n in enumerate(_DAYS, 1)) + """
FROM v_daily GROUP BY 1, 2)
SELECT brand, week, mon, tue, wed, thu, fri, sat, sun, mon + tue + wed + thu + fri + sat + sun AS week_total,
       mon + tue + coalesce(lag(sat) OVER k, 0) + coalesce(lag(sun) OVER k, 0) AS first_half,
       wed + thu + fri AS second_half
FROM w WINDOW k AS (PARTITION BY brand ORDER BY week)
""")
def weekday_pivot(t):
    daily = t.daily.withColumn("week", F.trunc("date", "week"))
    return ops.weekday_pivot(daily, ["brand"], "date", "week", "qty")


def _pivot_sql():
    stats = [("count", "count(*)"), ("min", "min(discount)"), ("median", "quantile_cont(discount, 0.5)"),
             ("max", "max(discount)")]
    out = []
    for value, name in (("1-URGENT", "urgent"), ("2-HIGH", "high")):
        only = f"FILTER (WHERE mechanic = '{value}')"
        out += [f"{fn} {only} AS {name}_{stat}" for stat, fn in stats]
        out += [f"round(avg(discount) {only}, 9) AS {name}_mean", f"CAST(sum(days) {only} AS BIGINT) AS {name}_days"]
    return ", ".join(out)


@query("agg11_promo_pivot", f"""
SELECT brand, month, {_pivot_sql()}
FROM (SELECT p.brand, CAST(date_trunc('month', x.start_date) AS DATE) AS month, x.mechanic, x.discount,
             date_diff('day', x.start_date, x.end_date) + 1 AS days
      FROM v_promotions x JOIN v_products p ON x.product = p.product) z GROUP BY 1, 2
""")
def promo_pivot(t):
    days = (F.datediff("end_date", "start_date") + 1).alias("days")
    posts = t.promotions.join(t.products.select("product", "brand"), "product").select(
        "brand", F.trunc("start_date", "month").alias("month"), "mechanic", "discount", days)
    named = posts.withColumn("mechanic", F.when(F.col("mechanic") == "1-URGENT", "urgent").otherwise("high"))
    # The median keeps a count per distinct discount, and discounts have two decimals.
    wide = named.groupBy("brand", "month").pivot("mechanic", ["urgent", "high"]).agg(
        F.count("mechanic").alias("count"), F.min("discount").alias("min"), F.round(F.avg("discount"), 9).alias("mean"),
        F.percentile("discount", 0.5).alias("median"), F.max("discount").alias("max"), F.sum("days").alias("days"))
    return wide.na.fill(0, ["urgent_count", "high_count"])


@query("agg12_onehot_counts", """
SELECT p.category, count(DISTINCT CASE WHEN x.return_flag = 'A' THEN x.invoice END) AS flag_1,
       count(DISTINCT CASE WHEN x.return_flag = 'N' THEN x.invoice END) AS flag_2,
       count(DISTINCT CASE WHEN x.return_flag = 'R' THEN x.invoice END) AS flag_3
FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY 1
""")
def onehot_counts(t):
    lines = t.primary_lines.select("product", "return_flag", "invoice").join(
        t.products.select("product", "category"), "product")
    return ops.onehot_counts(lines, ["category"], "return_flag", "invoice", "flag_")


@query("agg13_number_stats", """
SELECT brand, yearweek, coalesce(min(nullif(promo_qty, 0)), 0) AS promo_min, coalesce(max(nullif(promo_qty, 0)), 0)
       AS promo_max, coalesce(avg(nullif(promo_qty, 0)), 0) AS promo_mean
FROM v_weekly GROUP BY 1, 2
""")
def number_stats(t):
    base = t.weekly.withColumn("promo", F.nullif("promo_qty", F.lit(0.0)))
    return ops.number_stats(base, ["brand", "yearweek"], "promo")


@query("agg14_contribution", """
SELECT p.brand, sum(x.qty) AS qty, sum(1.0::DOUBLE) AS records,
       sum(x.qty) / (SELECT sum(qty) FROM v_lines) AS qty_share,
       sum(1.0::DOUBLE) / (SELECT count(*) FROM v_lines) AS records_share
FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY 1
""")
def contribution(t):
    lines = t.primary_lines.join(t.products.select("product", "brand"), "product").withColumn("records", F.lit(1.0))
    return ops.contribution(lines, ["brand"], ["qty", "records"])


@query("agg15_distribution_by_period", """
SELECT period, bin, count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY period) AS share
FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_discount AS bin FROM lineitem) x GROUP BY 1, 2
""")
def distribution_by_period(t):
    lines = t.lineitem.select(
        F.trunc("l_shipdate", "month").alias("period"), F.col("l_discount").alias("bin"))
    return ops.period_distribution(lines, "period", "bin")


@query("agg16_exact_percentiles", """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
       round(quantile_cont(o_totalprice, 0.9), 6) AS p90
FROM orders GROUP BY 1
""")
def exact_percentiles(t):
    out = ordering.exact_percentiles(
        t.orders.select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice",
        {"median": 0.5, "p90": 0.9})
    return out.withColumns({c: F.round(c, 6) for c in ("median", "p90")})


@query("agg17_robust_mode", """
WITH c AS (SELECT p.brand, date_diff('day', x.start_date, x.end_date) + 1 AS days, count(*) AS n
           FROM v_promotions x JOIN v_products p ON x.product = p.product GROUP BY 1, 2),
tied AS (SELECT * FROM c WHERE (brand, n) IN (SELECT (brand, max(n)) FROM c GROUP BY brand))
SELECT brand, CAST(coalesce(quantile_disc(days, 0.5) FILTER (WHERE days <> 1), 1) AS INTEGER) AS mode
FROM tied GROUP BY brand
""")
def robust_mode(t):
    days = (F.datediff("end_date", "start_date") + 1).alias("days")
    posts = t.promotions.join(t.products.select("product", "brand"), "product").select("brand", days)
    return ops.robust_mode(posts, ["brand"], "days")


@query("agg18_add_total", """
WITH b AS (SELECT brand, yearweek, region, sum(qty) AS qty FROM v_weekly GROUP BY 1, 2, 3)
SELECT * FROM b UNION ALL SELECT brand, yearweek, 'NATIONWIDE' AS region, sum(qty) AS qty FROM b GROUP BY 1, 2
""")
def add_total(t):
    return ops.add_total(t.weekly, ["brand", "yearweek"], "region", "NATIONWIDE", ["qty"])


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg19_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS corr FROM lineitem"
    for i, a in enumerate(_MEASURES) for b in _MEASURES[i:]))
def correlations(t):
    return ops.correlation_matrix(t.lineitem, _MEASURES).withColumn("corr", F.round("corr", 9))


@query("agg20_time_buckets", """
SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS bucket, round(sum(o_totalprice), 2) AS value,
       round(avg(o_totalprice), 4) AS mean_value, count(*) AS orders
FROM orders GROUP BY 1, 2
""")
def time_buckets(t):
    return t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("bucket")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"),
        F.count("*").alias("orders"))


@query("agg21_unpivot", """
SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
""")
def unpivot(t):
    wide = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return wide.unpivot("p_partkey", ["size", "price"], "measure", "value")


@query("srt01_global_sort", """
SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey
""")
def global_sort(t):
    return t.customer.select("c_mktsegment", "c_acctbal", "c_custkey").orderBy(
        "c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("srt02_top_products", """
SELECT product, date, sum(qty) AS qty FROM v_lines
WHERE product IN (SELECT product FROM v_lines GROUP BY product ORDER BY sum(qty) DESC, product LIMIT 100)
GROUP BY 1, 2
""")
def top_products(t):
    best = ranking.top_keys(t.primary_lines, "product", "qty", 100)
    return t.primary_lines.join(best, "product", "left_semi").groupBy("product", "date").agg(F.sum("qty").alias("qty"))


@query("srt03_top_per_category", """
SELECT category, product, qty, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY qty DESC, product) AS rank
      FROM (SELECT p.category, x.product, sum(x.qty) AS qty
            FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY 1, 2) a) b WHERE rank <= 5
""")
def top_per_category(t):
    totals = t.primary_lines.groupBy("product").agg(F.sum("qty").alias("qty"))
    named = totals.join(t.products.select("product", "category"), "product").select("category", "product", "qty")
    return ranking.top_per_group(named, ["category"], [F.desc("qty"), "product"], 5)


_FLAGS = {"fa": "A", "fn": "N", "fr": "R"}


@query("srt04_best_column", """
SELECT product, CASE WHEN fa >= fn AND fa >= fr THEN 'fa' WHEN fn >= fr THEN 'fn' ELSE 'fr' END AS best,
       greatest(fa, fn, fr) AS best_qty
FROM (SELECT product, sum(CASE WHEN return_flag = 'A' THEN qty ELSE 0 END) AS fa,
             sum(CASE WHEN return_flag = 'N' THEN qty ELSE 0 END) AS fn,
             sum(CASE WHEN return_flag = 'R' THEN qty ELSE 0 END) AS fr FROM v_lines GROUP BY 1) x
""")
def best_column(t):
    wide = t.primary_lines.groupBy("product").agg(*[
        F.sum(F.when(F.col("return_flag") == v, F.col("qty")).otherwise(0.0)).alias(n) for n, v in _FLAGS.items()])
    return wide.select("product", ranking.best_column(list(_FLAGS)).alias("best"),
                       F.greatest(*_FLAGS).alias("best_qty"))


@query("srt05_ordered_columns", """
SELECT product, string_agg(name, '>' ORDER BY v DESC, name) AS priority
FROM (SELECT product, name, sum(v) AS v FROM (
        SELECT product, 'fa' AS name, CASE WHEN return_flag = 'A' THEN qty ELSE 0 END AS v FROM v_lines
        UNION ALL SELECT product, 'fn', CASE WHEN return_flag = 'N' THEN qty ELSE 0 END FROM v_lines
        UNION ALL SELECT product, 'fr', CASE WHEN return_flag = 'R' THEN qty ELSE 0 END FROM v_lines) a GROUP BY 1, 2) b
GROUP BY 1
""")
def ordered_columns(t):
    wide = t.primary_lines.groupBy("product").agg(*[
        F.sum(F.when(F.col("return_flag") == v, F.col("qty")).otherwise(0.0)).alias(n) for n, v in _FLAGS.items()])
    return wide.select("product", F.array_join(ranking.ordered_columns(list(_FLAGS)), ">").alias("priority"))


@query("set01_union_all", """
SELECT 'sell-out' AS source, o_custkey AS member, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value FROM orders
UNION ALL SELECT 'web', user_id, CAST(ts AS DATE), value FROM events
""")
def union_all(t):
    orders = t.orders.select(
        F.lit("sell-out").alias("source"), F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"))
    web = t.events.select(
        F.col("user_id").alias("member"), F.to_date("ts").alias("date"), "value", F.lit("web").alias("source"))
    return orders.unionByName(web)


@query("set02_distinct_rows", """
SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem
""")
def distinct_rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").distinct()


@query("set03_old_wins", """
SELECT o_custkey, o_orderkey, batch FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY age, o_orderkey) AS rn FROM (
    SELECT o_custkey, o_orderkey, 'old' AS batch, 0 AS age FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'
    UNION ALL
    SELECT o_custkey, o_orderkey, 'new', 1 FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01') a) b WHERE rn = 1
""")
def old_wins(t):
    cut = F.lit("1996-01-01").cast("timestamp")
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    old = rows.where(F.col("o_orderdate") < cut).select("o_custkey", "o_orderkey", F.lit("old").alias("batch"))
    new = rows.where(F.col("o_orderdate") >= cut).select("o_custkey", "o_orderkey", F.lit("new").alias("batch"))
    return ranking.old_wins(old, new, ["o_custkey"], ["o_orderkey"])


@query("set04_member_overlap", """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2000-02-01'),
b AS (SELECT DISTINCT o_custkey FROM orders WHERE date_trunc('month', o_orderdate) = DATE '2000-03-01')
SELECT (SELECT count(*) FROM a) AS in_first, (SELECT count(*) FROM b) AS in_second,
       (SELECT count(*) FROM a JOIN b USING (o_custkey)) AS in_both
""")
def member_overlap(t):
    day = F.col("o_orderdate")
    at = lambda text: F.lit(text).cast("timestamp")
    first = (day >= at("2000-02-01")) & (day < at("2000-03-01"))
    second = (day >= at("2000-03-01")) & (day < at("2000-04-01"))
    return ranking.member_overlap(t.orders, "o_custkey", first, second)
