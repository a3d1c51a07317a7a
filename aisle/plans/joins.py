"""Queries: joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from aisle.functions import weeks
from aisle.operators import joins
from aisle.plans.registry import query



@query("jn01_inner_dimension", """
SELECT p.category, s.channel, sum(x.qty) AS qty, count(*) AS lines
FROM v_sales x JOIN v_products p ON x.product = p.product JOIN v_outlets s ON x.outlet = s.outlet GROUP BY 1, 2
""")
def inner_dimension(t):
    return (
        t.sales.join(t.products.select("product", "category"), "product")
        .join(t.outlets.select("outlet", "channel"), "outlet")
        .groupBy("category", "channel").agg(F.sum("qty").alias("qty"), F.count("*").alias("lines"))
    )


@query("jn02_left_other_names", """
SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey
AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-01-01'
""")
def left_other_names(t):
    late = t.orders.where(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"))
    ).select("o_orderkey", "o_custkey")
    return t.customer.join(late, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", "o_orderkey"
    )


@query("jn03_enrich_features", """
SELECT w.brand, w.region, w.week, w.qty, c.working_days, b.products, r.sites, d.day_qty
FROM v_weekly w
LEFT JOIN v_full_weeks c ON w.week = c.week
LEFT JOIN (SELECT brand, count(*) AS products FROM v_products GROUP BY 1) b ON w.brand = b.brand
LEFT JOIN (SELECT region, count(*) AS sites FROM v_sites GROUP BY 1) r ON w.region = r.region
LEFT JOIN (SELECT brand, date, qty AS day_qty FROM v_daily) d ON w.brand = d.brand AND w.week = d.date
""")
def enrich_features(t):
    products = t.products.groupBy("brand").agg(F.count("*").alias("products"))
    sites = t.sites.groupBy("region").agg(F.count("*").alias("sites"))
    day = t.daily.select("brand", F.col("date").alias("week"), F.col("qty").alias("day_qty"))
    frame = t.weekly.select("brand", "region", "week", "qty")
    return (
        frame.withColumn("working_days", weeks.working_days("week")).join(products, "brand", "left")
        .join(sites, "region", "left").join(day, ["brand", "week"], "left")
    )


@query("jn04_merge_features", """
SELECT brand, yearweek, a.sale_qty, b.return_weeks, c.schemes
FROM (SELECT brand, yearweek, sum(qty) AS sale_qty FROM v_weekly_secondary GROUP BY 1, 2) a
FULL JOIN (SELECT brand, yearweek, count(*) AS return_weeks FROM v_weekly WHERE return_qty > 0 GROUP BY 1, 2) b
USING (brand, yearweek)
FULL JOIN (SELECT p.brand, CAST(isoyear(start_date) * 100 + weekofyear(start_date) AS INTEGER) AS yearweek, count(*) AS schemes
           FROM v_promotions x JOIN v_products p ON x.product = p.product GROUP BY 1, 2) c USING (brand, yearweek)
""")
def merge_features(t):
    keys = ["brand", "yearweek"]
    sale = t.weekly_secondary.groupBy(*keys).agg(F.sum("qty").alias("sale_qty"))
    returns = t.weekly.where("return_qty > 0").groupBy(*keys).agg(F.count("*").alias("return_weeks"))
    schemes = t.promotions.join(t.products.select("product", "brand"), "product").groupBy(
        "brand", weeks.iso_yearweek("start_date").alias("yearweek")).agg(F.count("*").alias("schemes"))
    return joins.merge_features([sale, returns, schemes], keys)


@query("jn05_complete_dates", """
SELECT b.brand, d.date, coalesce(x.qty, 0) AS qty
FROM v_daily x RIGHT JOIN ((SELECT DISTINCT brand FROM v_products) b CROSS JOIN v_days d)
ON x.brand = b.brand AND x.date = d.date
""")
def complete_dates(t):
    keys = t.products.select("brand").distinct()
    days = F.sequence(*map(F.lit, t.span), F.expr("interval 1 day"))
    complete = joins.grid(keys, days, "date")
    return t.daily.select("brand", "date", "qty").join(complete, ["brand", "date"], "right").na.fill({"qty": 0.0})


@query("jn06_left_anti", """
SELECT c_custkey, c_mktsegment FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')
""")
def left_anti(t):
    recent = t.orders.where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp"))
    return t.customer.join(recent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(
        "c_custkey", "c_mktsegment"
    )


@query("jn07_anti_by_null", """
SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL
""")
def anti_by_null(t):
    return t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query("jn08_left_semi", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0.1 AND l_returnflag = 'R')
""")
def left_semi(t):
    returned = t.lineitem.where("l_discount = 0.1 and l_returnflag = 'R'").select("l_orderkey")
    return t.orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(
        "o_orderkey", "o_totalprice"
    )


@query("jn09_key_period_grid", """
SELECT k.brand, k.region, w.yearweek, coalesce(x.qty, 0) AS qty
FROM (SELECT DISTINCT brand, region FROM v_weekly) k CROSS JOIN v_weeks w
LEFT JOIN v_weekly x ON x.brand = k.brand AND x.region = k.region AND x.week = w.week
""")
def key_period_grid(t):
    keys = t.weekly.select("brand", "region").distinct()
    full = joins.grid(keys, t.mondays, "week")
    return full.join(t.weekly.select("brand", "region", "week", "qty"), ["brand", "region", "week"], "left").select(
        "brand", "region", weeks.iso_yearweek("week").alias("yearweek"), F.coalesce("qty", F.lit(0.0)).alias("qty")
    )


@query("jn10_apply_migration", """
SELECT coalesce(m.new_outlet, x.outlet) AS outlet, count(*) AS invoices, round(sum(x.price), 2) AS value
FROM (SELECT o_custkey AS outlet, o_totalprice AS price FROM orders) x
LEFT JOIN v_migration m ON x.outlet = m.prev_outlet GROUP BY 1
""")
def apply_migration(t):
    orders = t.orders.select(F.col("o_custkey").alias("outlet"), F.col("o_totalprice").alias("price"))
    moved = joins.apply_migration(orders, t.migration, "outlet", "prev_outlet", "new_outlet")
    return moved.groupBy("outlet").agg(F.count("*").alias("invoices"), F.round(F.sum("price"), 2).alias("value"))


@query("jn11_return_reference", """
WITH inv AS (SELECT l_orderkey AS invoice, CAST(min(l_shipdate) AS DATE) AS date, max(l_partkey) AS reference
             FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
ref AS (SELECT o_orderkey AS reference, min(CAST(o_orderdate AS DATE)) AS ref_date FROM orders GROUP BY 1)
SELECT invoice, inv.reference, coalesce(ref_date, date) AS effective_date
FROM inv LEFT JOIN ref ON inv.reference = ref.reference
""")
def return_reference(t):
    invoices = t.orders.select(
        F.col("o_orderkey").alias("invoice"), F.to_date("o_orderdate").alias("date")
    )
    returns = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("invoice")).agg(
        F.max("l_partkey").alias("reference"), F.to_date(F.min("l_shipdate")).alias("date")
    )
    return joins.resolve_return_date(returns, invoices, "invoice", "reference", "date").select(
        "invoice", "reference", "effective_date"
    )


@query("jn12_first_mapping", """
SELECT m.code AS product, count(*) AS lines, sum(x.l_quantity) AS qty
FROM lineitem x JOIN part p ON x.l_partkey = p.p_partkey
JOIN (SELECT p_name, p_brand, p_partkey AS code FROM (
        SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS rn FROM part) r
      WHERE rn = 1) m ON p.p_name = m.p_name AND p.p_brand = m.p_brand
GROUP BY 1
""")
def first_mapping(t):
    keyed = t.products.select("product", F.concat_ws("|", "dp_name", "brand").alias("customer_sku"))
    first = joins.first_mapping(keyed, "customer_sku", ["product"], "product").withColumnRenamed("product", "code")
    totals = t.lineitem.groupBy(F.col("l_partkey").alias("product")).agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("qty"))
    return (
        totals.join(keyed, "product").join(first, "customer_sku")
        .groupBy(F.col("code").alias("product")).agg(F.sum("lines").alias("lines"), F.sum("qty").alias("qty"))
    )


@query("jn13_working_days_between", """
SELECT scheme, start_date, end_date, CAST(count(d.date) AS BIGINT) AS working_days
FROM v_promotions p LEFT JOIN (SELECT date FROM v_days WHERE dayofweek(date) <> 0
     AND strftime(date, '%m%d') NOT IN ('0101', '0430', '0501', '0902')) d
ON d.date BETWEEN p.start_date AND p.end_date
GROUP BY ALL
""")
def working_days_between(t):
    calendar = weeks.calendar(t.spark, *t.span).select(
        "date", ((F.col("dayofweek") != 1) & ~F.col("is_holiday")).alias("working"))
    intervals = t.promotions.select("scheme", "start_date", "end_date")
    return joins.sum_between(intervals, calendar, "start_date", "end_date", "date", "working", "working_days")


@query("jn14_orders_traffic_tree", """
SELECT o.date, o.site, s.region, o.orders, o.units, o.gmv, t.visitors, t.views, t.buyers, t.web_gmv,
       round(o.orders / nullif(t.visitors, 0), 6) AS conversion
FROM (SELECT date, site, count(DISTINCT invoice) AS orders, sum(qty) AS units, round(sum(gsv), 4) AS gmv
      FROM v_sales GROUP BY 1, 2) o
LEFT JOIN v_traffic t ON o.date = t.date AND o.site = t.site
LEFT JOIN v_sites s ON o.site = s.site
""")
def orders_traffic_tree(t):
    orders = t.sales.groupBy("date", "site").agg(
        F.count_distinct("invoice").alias("orders"), F.sum("qty").alias("units"),
        F.round(F.sum("gsv"), 4).alias("gmv"))
    return (
        orders.join(t.traffic, ["date", "site"], "left").join(t.sites.select("site", "region"), "site", "left")
        .select("date", "site", "region", "orders", "units", "gmv", "visitors", "views", "buyers", "web_gmv",
                F.round(F.try_divide("orders", "visitors"), 6).alias("conversion"))
    )


@query("jn15_inner_date_product", """
SELECT o.date, o.site, o.gross_items, t.visitors, t.cart_users
FROM (SELECT date, site, count(*) AS gross_items FROM v_sales GROUP BY 1, 2) o
JOIN v_traffic t ON o.date = t.date AND o.site = t.site
""")
def inner_date_product(t):
    items = t.sales.groupBy("date", "site").agg(F.count("*").alias("gross_items"))
    return items.join(t.traffic, ["date", "site"]).select("date", "site", "gross_items", "visitors", "cart_users")


@query("jn16_year_ago", """
SELECT a.site, a.current, b.last_year, round(a.current / b.last_year - 1, 6) AS growth
FROM (SELECT site, round(sum(gsv), 4) AS current FROM v_sales
      WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-05-31' GROUP BY 1) a
JOIN (SELECT site, round(sum(gsv), 4) AS last_year FROM v_sales
      WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-05-31' GROUP BY 1) b ON a.site = b.site
""")
def year_ago(t):
    sums = joins.year_ago(t.sales, ["site"], "date", "gsv", F.lit(date(2000, 3, 1)), F.lit(date(2000, 5, 31)))
    rounded = sums.withColumns({"current": F.round("current", 4), "last_year": F.round("last_year", 4)})
    return rounded.withColumn("growth", F.round(F.col("current") / F.col("last_year") - 1, 6))


@query("jn17_combine_predictions", """
SELECT p.product, p.category AS category_pred, b.brand_pred, f.format_pred
FROM v_products p
JOIN (SELECT product, max(brand) AS brand_pred FROM v_products GROUP BY 1) b ON p.product = b.product
JOIN (SELECT product, CASE WHEN min(pack_size) < 20 THEN 'small' ELSE 'large' END AS format_pred
      FROM v_products GROUP BY 1) f ON p.product = f.product
""")
def combine_predictions(t):
    category = t.products.select("product", F.col("category").alias("category_pred"))
    brand = t.products.select("product", F.col("brand").alias("brand_pred"))
    form = t.products.select(
        "product", F.when(F.col("pack_size") < 20, "small").otherwise("large").alias("format_pred"))
    merged = joins.merge_features([category, brand, form], ["product"], "inner")
    return joins.dedupe(merged, ["product"], ["category_pred", "brand_pred"])


@query("jn18_where_join", """
SELECT o.o_orderkey, c.c_name FROM orders o, customer c
WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000
""")
def where_join(t):
    return t.orders.join(t.customer).where(
        (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 400000)
    ).select("o_orderkey", "c_name")


@query("jn19_class_by_quarter", """
WITH q AS (SELECT product, date_part('year', date) * 4 + date_part('quarter', date) - 1 AS quarter_no,
                  CASE WHEN sum(qty) >= 60 THEN 'A' ELSE 'B' END AS class FROM v_lines GROUP BY 1, 2),
p AS (SELECT scheme, product, start_date, end_date,
             date_part('year', start_date) * 4 + date_part('quarter', start_date) - 1 AS qs,
             date_part('year', end_date) * 4 + date_part('quarter', end_date) - 1 AS qe,
             CAST(date_trunc('quarter', end_date) AS DATE) AS edge FROM v_promotions),
k AS (SELECT scheme, product, CASE WHEN qe - qs = 1 AND date_diff('day', start_date, edge)
             >= date_diff('day', edge, end_date) THEN qs ELSE qe END AS quarter_no FROM p)
SELECT k.scheme, k.product, CAST(k.quarter_no AS INTEGER) AS quarter_no, coalesce(q.class, 'C') AS class
FROM k LEFT JOIN q ON k.product = q.product AND k.quarter_no = q.quarter_no
""")
def class_by_quarter(t):
    classes = t.primary_lines.groupBy("product", weeks.quarter_number("date").alias("quarter_no")).agg(
        F.when(F.sum("qty") >= 60, "A").otherwise("B").alias("class"))
    promotions = t.promotions.select("scheme", "product", "start_date", "end_date", F.lit("C").alias("class"))
    return joins.class_asof(promotions, classes, "start_date", "end_date").select(
        "scheme", "product", "quarter_no", "class"
    )


@query("jn20_key_event_join", """
WITH m AS (SELECT CAST(year(x.date) AS INTEGER) AS year, s.region AS banner, p.category, sum(x.qty) AS qty,
                  max(x.discount) AS depth
           FROM v_lines x JOIN v_products p ON x.product = p.product JOIN v_sites s ON x.site = s.site
           WHERE x.product IN (SELECT product FROM v_lines GROUP BY 1 HAVING count(DISTINCT site) >= 5)
           GROUP BY 1, 2, 3),
flags AS (SELECT CAST(year(x.date) AS INTEGER) AS year, s.region AS banner, p.category,
                 max(CASE WHEN month(x.date) = 12 AND x.discount >= 0.08 THEN 1 ELSE 0 END) AS key_event
          FROM v_lines x JOIN v_products p ON x.product = p.product JOIN v_sites s ON x.site = s.site GROUP BY 1, 2, 3)
SELECT m.year, m.banner, m.category, m.qty, coalesce(f.key_event, 0) AS key_event
FROM m LEFT JOIN flags f USING (year, banner, category)
""")
def key_event_join(t):
    categories = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    lines = (
        t.primary_lines.join(t.products.select("product", "category"), "product")
        .join(t.sites.select("site", "region"), "site")
        .select(F.year("date").alias("year"), F.month("date").alias("month"), F.col("region").alias("banner"),
                "category", "product", "site", "qty", "discount")
    )
    special = F.when((F.col("month") == 12) & (F.col("discount") >= 0.08), 1).otherwise(0)
    wide = lines.groupBy("year", "banner").pivot("category", categories).agg(F.max(special))
    flags = wide.unpivot(["year", "banner"], categories, "category", "key_event")
    core = t.primary_lines.groupBy("product").agg(F.count_distinct("site").alias("sites")).where("sites >= 5")
    fact = lines.join(core, "product", "left_semi").groupBy("year", "banner", "category").agg(F.sum("qty").alias("qty"))
    return fact.join(flags, ["year", "banner", "category"], "left").na.fill({"key_event": 0})
