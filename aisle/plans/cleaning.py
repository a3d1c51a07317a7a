"""Queries: projections, filters and cleaning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from aisle.functions import exprs, weeks
from aisle.operators import cleaning
from aisle.plans.registry import query
from aisle.sources.readers import clean_columns


@query("prj01_product_hierarchy", """
SELECT right(lpad(CAST(p_partkey AS VARCHAR), 18, '0'), 8) AS product_code, substr(p_type, 1, 4) AS category_code,
       p_type AS big_category, p_brand AS small_category, p_name AS dp_name
FROM part
""")
def product_hierarchy(t):
    parts = t.part.withColumn("material", F.lpad(F.col("p_partkey").cast("string"), 18, "0"))
    return cleaning.product_hierarchy(
        parts, "material", {"p_type": "big_category", "p_brand": "small_category", "p_name": "dp_name"}
    )


@query("prj02_category_code", """
SELECT substr(p_type, 1, 4) AS category_code, count(*) AS products FROM part GROUP BY 1
""")
def category_code(t):
    return t.part.groupBy(F.substring("p_type", 1, 4).alias("category_code")).agg(F.count("*").alias("products"))


@query("prj03_clean_columns", """
SELECT o_orderkey AS order_key, o_totalprice AS total_price_vnd, o_orderpriority AS priority FROM orders
""")
def clean_column_names(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias(" Order  Key "),
        F.col("o_totalprice").alias("Total Price (VND)"),
        F.col("o_orderpriority").alias("__Priority__"),
    )
    return clean_columns(raw)


@query("prj04_normalize_keys", """
SELECT c_custkey, lower(trim(c_name)) AS c_name, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer
""")
def normalize_keys(t):
    return cleaning.normalize_keys(
        t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], case="lower"
    )


@query("prj05_split_deal_id", """
SELECT scheme, substr(deal, 1, 2) AS deal_type, substr(deal, 3, 8) AS scheme_code, substr(deal, 11, 2) AS region_code,
       substr(deal, 13) AS deal_rest
FROM (SELECT o_orderkey AS scheme,
             concat('D', o_orderstatus, lpad(CAST(o_orderkey AS VARCHAR), 8, '0'),
                    lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0'), o_orderpriority) AS deal FROM orders) x
""")
def split_deal_id(t):
    deals = t.orders.select(
        F.col("o_orderkey").alias("scheme"),
        F.concat(
            F.lit("D"), "o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 8, "0"),
            F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), "o_orderpriority",
        ).alias("deal"),
    )
    parts = cleaning.split_fixed("deal", [("deal_type", 2), ("scheme_code", 8), ("region_code", 2)], "deal_rest")
    return deals.select("scheme", *parts)


@query("prj06_split_key", """
SELECT split_part(key, '|', 1) AS banner, split_part(key, '|', 2) AS category, split_part(key, '|', 3) AS dp_name,
       qty
FROM (SELECT concat_ws('|', s.region, p.category, p.dp_name) AS key, sum(x.qty) AS qty
      FROM v_lines x JOIN v_products p ON x.product = p.product JOIN v_sites s ON x.site = s.site GROUP BY 1) k
""")
def split_key(t):
    keyed = (
        t.primary_lines.join(t.products, "product").join(t.sites, "site")
        .groupBy("region", "category", "dp_name").agg(F.sum("qty").alias("qty"))
        .select(F.concat_ws("|", "region", "category", "dp_name").alias("key"), "qty")
    )
    return keyed.select(*cleaning.split_key("key", ["banner", "category", "dp_name"]), "qty")


_UNITS = """
SELECT category, product, qty, qty / pack_size AS cases, qty / pack_size * (price / 100) AS kg,
       qty / pack_size * (price / 100) / 1000 AS ton, qty / 1000 AS kpcs
FROM (SELECT p.category, x.product, p.pack_size, p.price, sum(x.qty) AS qty
      FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY ALL) u
"""


def _units(t):
    totals = t.primary_lines.groupBy("product").agg(F.sum("qty").alias("qty"))
    return totals.join(t.products, "product").select(
        "category", "product", "qty", *cleaning.convert_units("qty", "pack_size", F.col("price") / 100)
    )


@query("prj07_convert_units", f"""
SELECT category, product, qty, cases, kg, ton, kpcs FROM ({_UNITS}) c
""")
def convert_units(t):
    return _units(t)


@query("prj08_category_measure", f"""
SELECT category, product, CASE WHEN category IN ('SMALL', 'MEDIUM') THEN cases
       WHEN category = 'PROMO' THEN kpcs ELSE ton END AS actual_sale
FROM ({_UNITS}) c
""")
def category_measure(t):
    measure = cleaning.category_measure("category", ["SMALL", "MEDIUM"], ["PROMO"])
    return _units(t).select("category", "product", measure.alias("actual_sale"))


@query("prj09_recode", """
SELECT CASE region WHEN 'MIDDLE EAST' THEN 'ME' WHEN 'EUROPE' THEN 'EU' ELSE region END AS banner,
       CASE yearweek WHEN 199901 THEN 199853 ELSE yearweek END AS yearweek, sum(qty) AS qty
FROM v_weekly GROUP BY 1, 2
""")
def recode(t):
    return t.weekly.groupBy(
        exprs.recode("region", {"MIDDLE EAST": "ME", "EUROPE": "EU"}).alias("banner"),
        exprs.recode("yearweek", {199901: 199853}).alias("yearweek"),
    ).agg(F.sum("qty").alias("qty"))


@query("prj10_clip_negative", """
SELECT c_custkey, greatest(c_acctbal, 0.0::DOUBLE) AS balance FROM customer
""")
def clip_negative(t):
    return t.customer.select("c_custkey", exprs.clip_lower("c_acctbal").alias("balance"))


@query("flt01_sales_filter", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
""")
def sales_filter(t):
    return t.orders.where(
        (F.col("o_orderstatus") != "P")
        & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
        & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("flt02_like_exclusions", """
SELECT p_partkey, p_name, p_type FROM part
WHERE p_name NOT LIKE '%gizmo%' AND p_name LIKE '% %' AND p_type NOT IN ('PROMO', 'ECONOMY')
""")
def like_exclusions(t):
    name = F.col("p_name")
    return t.part.where(
        ~name.like("%gizmo%") & name.like("% %") & ~F.col("p_type").isin("PROMO", "ECONOMY")
    ).select("p_partkey", "p_name", "p_type")


@query("flt03_regex_exclusion", """
SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(p_name, '^(old|cold) |gear|plate')
""")
def regex_exclusion(t):
    return t.part.where(~F.col("p_name").rlike("^(old|cold) |gear|plate")).select("p_partkey", "p_name")


@query("flt04_null_handling", """
SELECT d.doc_id, l.quality, coalesce(l.toxic, 0) AS toxic, coalesce(nullif(d.source, 'src0'), 'unknown') AS source
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL
""")
def null_handling(t):
    joined = t.documents.select("doc_id", F.nullif("source", F.lit("src0")).alias("source")).join(
        t.labels, "doc_id", "left"
    )
    kept = cleaning.drop_incomplete(joined, ["quality"])
    return cleaning.fill_nulls(kept, {"toxic": 0, "source": "unknown"}).select(
        "doc_id", "quality", "toxic", "source"
    )


@query("flt05_safe_ratio", """
SELECT brand, region, week, CASE WHEN qty - return_qty = 0 THEN 0 ELSE round(promo_qty / (qty - return_qty), 6) END
       AS promo_ratio
FROM v_weekly
""")
def safe_ratio(t):
    return t.weekly.select(
        "brand", "region", "week",
        F.round(exprs.safe_div("promo_qty", F.col("qty") - F.col("return_qty")), 6).alias("promo_ratio"),
    )


@query("flt06_drop_inactive", """
SELECT outlet, date, sum(qty) AS qty FROM v_sales s
WHERE outlet IN (SELECT outlet FROM v_sales GROUP BY outlet HAVING date_diff('day', max(date), DATE '2001-08-01') <= 90)
GROUP BY outlet, date
""")
def drop_inactive(t):
    by_day = t.sales.groupBy("outlet", "date").agg(F.sum("qty").alias("qty"))
    return cleaning.drop_inactive(by_day, ["outlet"], "date", F.lit(date(2001, 8, 1)), 90)


@query("flt07_keep_long_series", """
SELECT brand, region, week, qty FROM v_weekly w
WHERE (brand, region) IN (SELECT (brand, region) FROM v_weekly GROUP BY brand, region
                          HAVING max(week_no) - min(week_no) + 1 >= 340)
""")
def keep_long_series(t):
    return cleaning.keep_long_series(t.weekly, ["brand", "region"], "week_no", 340).select(
        "brand", "region", "week", "qty"
    )


@query("flt08_scalar_period", """
SELECT period, o_orderkey, o_totalprice
FROM orders, (SELECT 'month_to_date' AS period, DATE '2000-03-01' AS a, DATE '2000-03-30' AS b) p
WHERE CAST(o_orderdate AS DATE) BETWEEN a AND b
""")
def scalar_period(t):
    period = weeks.period_table(t.spark, date(2000, 3, 31)).where("period = 'month_to_date'")
    orders = t.orders.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))
    return cleaning.in_period(orders, "date", period).select("period", "o_orderkey", "o_totalprice")


@query("flt09_active_products", """
SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem
WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') GROUP BY l_partkey
""")
def active_products(t):
    active = t.lineitem.where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp")).select("l_partkey")
    totals = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return totals.join(active, "l_partkey", "left_semi")


@query("flt10_drop_zero_series", """
SELECT brand, region, week, return_qty FROM v_weekly
WHERE (brand, region) IN (SELECT (brand, region) FROM v_weekly GROUP BY brand, region HAVING sum(return_qty) > 0)
""")
def drop_zero_series(t):
    return cleaning.drop_zero_series(t.weekly, ["brand", "region"], "return_qty").select(
        "brand", "region", "week", "return_qty"
    )
