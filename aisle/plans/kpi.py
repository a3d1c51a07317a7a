"""Queries: sell-out KPIs, propensity, e-commerce and compliance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from aisle.functions import weeks
from aisle.operators import kpi as ops, ordering, quality, timeseries as ts, windows as wops
from aisle.plans.registry import query
from aisle.session import stored

RUN = date(2000, 3, 31)
PEER = ["region", "channel", "category"]

_MASTER = """
SELECT x.date, x.site, s.region, s.distributor, coalesce(m.new_outlet, x.outlet) AS outlet, o.channel, x.product, p.dp_name,
       p.brand, p.category, x.qty, x.gsv, x.invoice, x.status
FROM v_sales x LEFT JOIN v_migration m ON x.outlet = m.prev_outlet
JOIN v_outlets o ON coalesce(m.new_outlet, x.outlet) = o.outlet JOIN v_products p ON x.product = p.product
LEFT JOIN v_sites s ON x.site = s.site WHERE x.status <> 'P'
"""


def _master(t):
    columns = ["date", "site", "outlet", "product", "qty", "gsv", "invoice", "status"]
    return ops.master_dataset(t.sales.select(*columns), t.migration, t.outlets, t.products, t.sites, ["P"])


def _r(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("kpi01_master_dataset", f"""
SELECT region, channel, category, date, count(*) AS lines, sum(qty) AS qty, round(sum(gsv), 4) AS gsv
FROM ({_MASTER}) m GROUP BY 1, 2, 3, 4
""")
def master_dataset(t):
    return _master(t).groupBy("region", "channel", "category", "date").agg(
        F.count("qty").alias("lines"), F.sum("qty").alias("qty"), F.round(F.sum("gsv"), 4).alias("gsv"))


_MEAN = f"""
mean AS (SELECT region, channel, category, round(sum(gsv), 4) AS gsv, count(DISTINCT outlet) AS eco,
                count(DISTINCT dp_name) AS assortment, count(DISTINCT site) AS sites FROM m
         WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31' GROUP BY 1, 2, 3),
mean_ly AS (SELECT region, channel, category, round(sum(gsv), 4) AS gsv_ly FROM m
            WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31' GROUP BY 1, 2, 3)"""


def _rounded_sum(df, c):
    return df.withColumn(c, F.round(c, 4))


def _mean(t):
    return _rounded_sum(ops.mean_performance(ops.month_to_date(_master(t), "date", RUN), PEER), "gsv")


@query("kpi02_mean_performance", f"""
WITH m AS ({_MASTER}),{_MEAN}
SELECT region, channel, category, gsv, round(gsv / assortment, 6) AS gsv_per_assortment, eco / sites AS eco_per_site,
       assortment / sites AS assortment_per_site FROM mean
""")
def mean_performance(t):
    return _r(_mean(t), 6, "gsv_per_assortment")


@query("kpi02_cluster_performance", f"""
WITH m AS ({_MASTER}),
v AS (SELECT site, sum(gsv) AS gsv FROM v_lines GROUP BY 1),
cl AS (SELECT site, CASE WHEN upto / total <= 0.8 THEN 'A' WHEN upto / total <= 0.95 THEN 'B' ELSE 'C' END AS cluster
       FROM (SELECT site, sum(gsv) OVER () AS total, sum(gsv) OVER (ORDER BY gsv DESC, site ROWS UNBOUNDED PRECEDING) AS upto FROM v) z),
g AS (SELECT region, channel, category, cluster, round(sum(gsv), 4) AS gsv, count(DISTINCT outlet) AS eco,
             count(DISTINCT dp_name) AS assortment, count(DISTINCT m.site) AS sites FROM m JOIN cl ON m.site = cl.site
      WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31' GROUP BY ALL)
SELECT region, channel, category, cluster, gsv, round(gsv / assortment, 6) AS gsv_per_assortment, eco / sites AS eco_per_site,
       assortment / sites AS assortment_per_site FROM g
""")
def cluster_performance(t):
    """Peers are sites of one cluster as well; the cluster is the Pareto class of the site's whole sales."""
    totals = t.primary_lines.groupBy("site").agg(F.sum("gsv").alias("gsv"))
    clusters = ordering.abc_classes(totals, "site", "gsv").select("site", F.col("abc_class").alias("cluster"))
    month = ops.month_to_date(_master(t), "date", RUN).join(clusters, "site")
    return _r(_rounded_sum(ops.mean_performance(month, [*PEER, "cluster"]), "gsv"), 6, "gsv_per_assortment")


_SITE = """
site AS (SELECT site, region, channel, category, round(sum(gsv), 4) AS indi_gsv, count(DISTINCT outlet) AS indi_eco,
                count(DISTINCT dp_name) AS indi_assortment FROM m
         WHERE date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31' GROUP BY 1, 2, 3, 4),
site_ly AS (SELECT site, region, channel, category, round(sum(gsv), 4) AS gsv_ly FROM m
            WHERE date BETWEEN DATE '1999-03-01' AND DATE '1999-03-31' GROUP BY 1, 2, 3, 4)"""


def _site(t):
    return _rounded_sum(ops.site_performance(ops.month_to_date(_master(t), "date", RUN), PEER), "indi_gsv")


@query("kpi03_site_performance", f"""
WITH m AS ({_MASTER}),{_SITE}
SELECT site, region, channel, category, indi_gsv, indi_eco, indi_assortment,
       round(indi_gsv / indi_assortment, 6) AS indi_gsv_per_assortment FROM site
""")
def site_performance(t):
    return _r(_site(t), 6, "indi_gsv_per_assortment")


def _two_months(t):
    """The master of the two months that are compared, joined once and stored, since levels and years read it again."""
    columns = ["site", *PEER, "outlet", "dp_name", "gsv", "_now"]
    return stored(ops.both_months(_master(t), "date", RUN).select(*columns), "two-months")


def _mean_growth(months):
    return ops.growth_of(months, ops.mean_performance, PEER, "gsv", "mean_growth", 4)


@query("kpi04_growth_vs_last_year", f"""
WITH m AS ({_MASTER}),{_MEAN}
SELECT region, channel, category, gsv, round(gsv / assortment, 6) AS gsv_per_assortment, eco / sites AS eco_per_site,
       assortment / sites AS assortment_per_site, gsv_ly, round(gsv / gsv_ly - 1, 9) AS mean_growth
FROM mean JOIN mean_ly USING (region, channel, category)
""")
def growth_vs_last_year(t):
    return _r(_r(_mean_growth(_two_months(t)), 6, "gsv_per_assortment"), 9, "mean_growth")


def _scaled_sql(c):
    return f"(CAST({c} AS DOUBLE) - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0)"


_PAIRS = [("eco", "indi_eco", "eco_per_site"), ("assortment", "indi_assortment", "assortment_per_site"),
          ("gsv_per_assortment", "indi_gpa", "gpa")]


@query("kpi05_site_vs_peers", f"""
WITH m AS ({_MASTER}),{_MEAN},{_SITE},
j AS (SELECT s.site, region, channel, category, s.indi_eco, s.indi_assortment, s.indi_gsv / s.indi_assortment AS indi_gpa,
             a.eco / a.sites AS eco_per_site, a.assortment / a.sites AS assortment_per_site, a.gsv / a.assortment AS gpa,
             s.indi_gsv / sl.gsv_ly - 1 AS indi_growth, a.gsv / al.gsv_ly - 1 AS mean_growth
      FROM site s JOIN site_ly sl USING (site, region, channel, category) JOIN mean a USING (region, channel, category)
      JOIN mean_ly al USING (region, channel, category)),
k AS (SELECT *, {", ".join(f"{_scaled_sql(o)} / nullif({_scaled_sql(p)}, 0) - 1 AS gap_{n}" for n, o, p in _PAIRS)} FROM j)
SELECT site, region, channel, category, CASE WHEN indi_growth > mean_growth THEN 'better' ELSE 'worse' END AS is_growth_better,
       {", ".join(f"round(gap_{n}, 7) AS gap_{n}" for n, _, _ in _PAIRS)},
       (SELECT string_agg(name, '>' ORDER BY v DESC NULLS LAST, o) FROM
        (VALUES ('gap_eco', gap_eco, 1), ('gap_assortment', gap_assortment, 2), ('gap_gsv_per_assortment', gap_gsv_per_assortment, 3))
        z(name, v, o)) AS focus_order
FROM k
""")
def site_vs_peers(t):
    keys, months = ["site", *PEER], _two_months(t)
    own = lambda df, _: ops.site_performance(df, PEER)
    site = ops.growth_of(months, own, keys, "indi_gsv", "indi_growth", 4).drop("gsv_ly")
    peers = _mean_growth(months).drop("gsv_ly")
    out = ops.compare_with_peers(site, peers, PEER)
    names = [f"gap_{n}" for n in ops.COMPONENTS]
    return out.select(
        *keys, "is_growth_better", *[F.round(c, 7).alias(c) for c in names],
        F.array_join("focus_order", ">").alias("focus_order"))


_TYPES = ["A", "B", "C", "D", "E"]
_STEPS = [(80000.0, "A"), (50000.0, "B"), (30000.0, "C"), (15000.0, "D")]


@query("kpi06_site_profile", f"""
WITH m AS ({_MASTER}),
o AS (SELECT outlet, site, round(sum(gsv) FILTER (WHERE date BETWEEN DATE '2000-02-01' AND DATE '2000-02-29'), 4) AS gsv,
             round(sum(gsv) FILTER (WHERE date BETWEEN DATE '1999-12-30' AND DATE '2000-03-30') / 3, 4) AS l3m
      FROM m WHERE date BETWEEN DATE '1999-12-30' AND DATE '2000-03-30' GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN l3m >= 80000 THEN 'A' WHEN l3m >= 50000 THEN 'B' WHEN l3m >= 30000 THEN 'C' WHEN l3m >= 15000 THEN 'D'
             ELSE 'E' END AS k FROM o WHERE gsv IS NOT NULL)
SELECT site, round(sum(gsv), 4) AS total_gsv, count(*) FILTER (WHERE gsv > 0) AS total_eco,
       {", ".join(f"count(DISTINCT outlet) FILTER (WHERE k = '{k}') / count(*) AS coverage_{i}" for i, k in enumerate(_TYPES, 1))},
       {", ".join(f"round(coalesce(sum(gsv) FILTER (WHERE k = '{k}'), 0) / sum(gsv), 9) AS gsv_share_{i}" for i, k in enumerate(_TYPES, 1))}
FROM p GROUP BY 1 HAVING sum(gsv) <> 0
""")
def site_profile(t):
    tiers = ops.outlet_tiers(_master(t), "date", RUN, _STEPS, "E")
    out = ops.site_profile(_r(tiers, 4, "gsv"), _TYPES)
    return _r(_r(out, 4, "total_gsv"), 9, *[f"gsv_share_{i}" for i in range(1, 6)])


@query("kpi07_next_week_labels", """
SELECT outlet, """ + ", ".join(
    f"max(CASE WHEN (date_diff('day', DATE '2000-03-31', date) - 1) // 7 + 1 = {i} THEN 1 ELSE 0 END) AS buy_next_{i}w"
    for i in range(1, 5)) + """
FROM v_sales WHERE date > DATE '2000-03-31' AND date <= DATE '2000-04-28' GROUP BY 1
""")
def next_week_labels(t):
    return ops.next_week_labels(t.sales, ["outlet"], "date", RUN)


@query("kpi08_rfm_features", """
WITH b AS (SELECT outlet, invoice, date, sum(gsv) AS v FROM v_sales WHERE date <= DATE '2000-03-31' GROUP BY 1, 2, 3)
SELECT outlet, round(sum(CASE WHEN date > DATE '2000-03-24' THEN v ELSE 0 END), 4) AS gsv_l1w,
       round(sum(CASE WHEN date > DATE '1999-09-30' THEN v ELSE 0 END), 4) AS gsv_l6m,
       count(*) FILTER (WHERE date > DATE '2000-03-24') AS bills_l1w, count(*) FILTER (WHERE date > DATE '1999-09-30') AS bills_l6m,
       round(avg(v) FILTER (WHERE date > DATE '1999-09-30'), 6) AS order_value_l6m,
       CAST(CASE WHEN date_diff('day', max(date), DATE '2000-03-31') <= 365 THEN date_diff('day', max(date), DATE '2000-03-31') END
            AS INTEGER) AS recency,
       CAST(date_diff('day', min(date), DATE '2000-03-31') AS INTEGER) AS lifetime,
       count(DISTINCT date_trunc('month', date)) AS months_with_bill
FROM b GROUP BY 1
""")
def rfm_features(t):
    out = ops.rfm_features(t.sales, ["outlet"], "date", RUN)
    return _r(_r(out, 4, "gsv_l1w", "gsv_l6m"), 6, "order_value_l6m")


_FLAGS = ", ".join(
    f"max(CASE WHEN (date_diff('day', DATE '{{d}}', date) - 1) // 7 + 1 = {i} THEN 1 ELSE 0 END) AS {{p}}{i}" for i in range(1, 5))


@query("kpi09_monthly_hits", f"""
WITH b AS (SELECT outlet, {_FLAGS.format(d='2000-03-31', p='b')} FROM v_sales
           WHERE date > DATE '2000-03-31' AND date <= DATE '2000-04-28' GROUP BY 1),
p AS (SELECT outlet, {_FLAGS.format(d='1999-03-31', p='p')} FROM v_sales
      WHERE date > DATE '1999-03-31' AND date <= DATE '1999-04-28' GROUP BY 1),
j AS (SELECT o.channel, o.balance, (coalesce(greatest(b1, b2, b3, b4), 0) > 0) = (coalesce(greatest(p1, p2, p3, p4), 0) > 0)
             AS is_correct FROM v_outlets o LEFT JOIN b USING (outlet) LEFT JOIN p USING (outlet))
SELECT channel, is_correct, count(*) AS members, round(sum(balance), 2) AS value,
       round(sum(balance) / sum(sum(balance)) OVER (PARTITION BY channel), 8) AS value_share
FROM j GROUP BY 1, 2
""")
def monthly_hits(t):
    labels = ops.next_week_labels(t.sales, ["outlet"], "date", RUN)
    before = ops.next_week_labels(t.sales, ["outlet"], "date", date(1999, 3, 31)).withColumnsRenamed(
        {f"buy_next_{i}w": f"pred_{i}" for i in range(1, 5)})
    names, preds = [f"buy_next_{i}w" for i in range(1, 5)], [f"pred_{i}" for i in range(1, 5)]
    frame = t.outlets.join(labels, "outlet", "left").join(before, "outlet", "left").na.fill(0, [*names, *preds])
    return _r(_r(ops.monthly_hits(frame, ["channel"], names, preds, "balance"), 2, "value"), 8, "value_share")


@query("kpi10_period_report", """
WITH p AS (SELECT * FROM (VALUES
  ('yesterday', DATE '2000-03-30', DATE '2000-03-30'), ('previous_day', DATE '2000-03-29', DATE '2000-03-29'),
  ('last_7_days', DATE '2000-03-24', DATE '2000-03-30'), ('previous_7_days', DATE '2000-03-17', DATE '2000-03-23'),
  ('last_30_days', DATE '2000-03-01', DATE '2000-03-30'), ('previous_30_days', DATE '2000-01-31', DATE '2000-02-29'),
  ('month_to_date', DATE '2000-03-01', DATE '2000-03-30'),
  ('previous_month_to_date', DATE '2000-02-01', DATE '2000-02-29')) v(period, a, b))
SELECT period, round(sum(gsv), 4) AS gmv, round(sum(CASE WHEN status <> 'P' THEN gsv ELSE 0 END), 4) AS nmv,
       count(DISTINCT invoice) AS gross_orders, count(DISTINCT CASE WHEN status <> 'P' THEN invoice END) AS net_orders,
       sum(qty) AS gross_items, sum(CASE WHEN status <> 'P' THEN qty ELSE 0 END) AS net_items
FROM v_sales JOIN p ON date BETWEEN a AND b GROUP BY 1
""")
def period_report(t):
    return _r(ops.period_report(t.sales, "date", RUN), 4, "gmv", "nmv")


@query("kpi11_daily_performance", """
SELECT o.date, o.site, s.region, gmv, nmv, gross_orders, gross_items, visitors, views, buyers,
       gross_orders / nullif(visitors, 0) AS conversion, round(gmv / nullif(buyers, 0), 6) AS gmv_per_buyer
FROM (SELECT date, site, round(sum(gsv), 4) AS gmv, round(sum(CASE WHEN status <> 'P' THEN gsv ELSE 0 END), 4) AS nmv,
             count(DISTINCT invoice) AS gross_orders, sum(qty) AS gross_items FROM v_sales GROUP BY 1, 2) o
LEFT JOIN v_traffic t ON o.date = t.date AND o.site = t.site LEFT JOIN v_sites s ON o.site = s.site
""")
def daily_performance(t):
    return _r(_r(ops.daily_performance(t.sales, t.traffic, t.sites), 4, "gmv", "nmv"), 6, "gmv_per_buyer")


_STOCK = """
WITH s AS (SELECT product, date, sum(qty) AS stock FROM v_lines WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-10-31' GROUP BY 1, 2),
g AS (SELECT k.product, d.date, s.stock FROM (SELECT DISTINCT product FROM s) k
      CROSS JOIN (SELECT date FROM v_days WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-10-31') d
      LEFT JOIN s ON s.product = k.product AND s.date = d.date),
f AS (SELECT product, date, last_value(stock IGNORE NULLS) OVER (PARTITION BY product ORDER BY date
             ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS stock FROM g)
"""


def _inventory(t):
    stock = t.primary_lines.groupBy("product", "date").agg(F.sum("qty").alias("stock"))
    return ops.inventory_report(stock, "product", date(2001, 7, 1), date(2001, 10, 31))


@query("kpi12_inventory_report", _STOCK + "SELECT product, date, stock FROM f WHERE stock IS NOT NULL")
def inventory_report(t):
    return _inventory(t)


@query("kpi12_latest_inventory", _STOCK + """
SELECT product, stock FROM f WHERE stock IS NOT NULL AND date = DATE '2001-10-31'
""")
def latest_inventory(t):
    return _inventory(t).where(F.col("date") == F.lit(date(2001, 10, 31))).select("product", "stock")


_ORDERS = """(SELECT site, CAST(isoyear(date) * 100 + weekofyear(date) AS INTEGER) AS yearweek,
              CAST(date_trunc('week', date) AS DATE) AS week, status, qty AS proposed,
              CASE WHEN return_flag = 'R' THEN qty * 0.5::DOUBLE ELSE qty END AS confirmed FROM v_sales) x"""


def _orders(t):
    confirmed = F.when(F.col("return_flag") == "R", F.col("qty") * 0.5).otherwise(F.col("qty"))
    return t.sales.select(
        "site", weeks.iso_yearweek("date").alias("yearweek"), weeks.week_start("date").alias("week"), "status",
        F.col("qty").alias("proposed"), confirmed.alias("confirmed"), "qty")


_RATE = """CAST(round(CAST(CAST(1 - abs(sum(confirmed) - sum(proposed)) / nullif(sum(proposed), 0) AS VARCHAR) AS DECIMAL(38, 20)), 2)
  AS DOUBLE)"""


@query("kpi13_compliance_rate", f"""
SELECT site, yearweek, sum(proposed) AS proposed, sum(confirmed) AS confirmed, {_RATE} AS compliance_rate FROM {_ORDERS} GROUP BY 1, 2
""")
def compliance_rate(t):
    return ops.compliance_rate(_orders(t), ["site", "yearweek"])


@query("kpi13_manual_rate", f"""
SELECT site, yearweek, sum(CASE WHEN status = 'F' THEN proposed ELSE 0 END) AS qty_1,
       sum(CASE WHEN status = 'O' THEN proposed ELSE 0 END) AS qty_2, sum(CASE WHEN status = 'P' THEN proposed ELSE 0 END) AS qty_3,
       CAST(round(CAST(sum(CASE WHEN status = 'P' THEN proposed ELSE 0 END) / nullif(sum(proposed), 0) AS DECIMAL(18, 12)), 4) AS DOUBLE)
       AS manual_rate
FROM {_ORDERS} GROUP BY 1, 2
""")
def manual_rate(t):
    return ops.manual_rate(_orders(t), ["site", "yearweek"], "status", ["P"])


@query("kpi14_compliance_features", f"""
WITH r AS (SELECT site, week, sum(proposed) AS proposed, {_RATE} AS rate FROM {_ORDERS} GROUP BY 1, 2),
d AS (SELECT k.site, CAST(w AS DATE) AS week, r.rate, coalesce(r.proposed, 0) AS proposed
      FROM (SELECT site, min(week) AS a FROM r GROUP BY 1) k,
           unnest(generate_series(CAST(a AS TIMESTAMP), CAST((SELECT max(week) FROM r) AS TIMESTAMP), INTERVAL 7 DAY)) u(w)
      LEFT JOIN r ON r.site = k.site AND r.week = CAST(w AS DATE)),
q AS (SELECT site, round(count(*) FILTER (WHERE rate IS NULL) / count(*), 2) AS gap FROM d GROUP BY 1),
a AS (SELECT site, CASE WHEN upto / total <= 0.8 THEN 'A' WHEN upto / total <= 0.95 THEN 'B' ELSE 'C' END AS class
      FROM (SELECT site, sum(v) OVER () AS total, sum(v) OVER (ORDER BY v DESC, site ROWS UNBOUNDED PRECEDING) AS upto
            FROM (SELECT site, sum(proposed) AS v FROM r GROUP BY 1) s) z),
f AS (SELECT d.site, d.week, coalesce(d.rate, 0) AS rate, d.proposed, s.region, c.working_days, a.class, q.gap <= 0.6 AS good
      FROM d JOIN v_sites s ON d.site = s.site LEFT JOIN v_full_weeks c ON d.week = c.week JOIN a ON d.site = a.site
      JOIN q ON d.site = q.site)
SELECT site, week, rate, proposed, region, working_days, class, good, rate_lag_2, rate_lag_4,
       round(avg(rate_lag_2) OVER (PARTITION BY site ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8)
       AS rate_lag_2_rolling_mean_4
FROM (SELECT *, lag(rate, 2) OVER (PARTITION BY site ORDER BY week) AS rate_lag_2,
             lag(rate, 4) OVER (PARTITION BY site ORDER BY week) AS rate_lag_4 FROM f) g
""")
def compliance_features(t):
    rates = ops.compliance_rate(_orders(t), ["site", "week"]).select("site", "week", "proposed", F.col("compliance_rate").alias("rate"))
    dense = ts.densify(rates, ["site"], "week", ["proposed"], "interval 7 days", rates.agg(F.max("week")).scalar())
    profile = quality.coverage_profile(dense, ["site"], "week", "rate")
    totals = rates.groupBy("site").agg(F.sum("proposed").alias("volume"))
    classes = ordering.abc_classes(totals, "site", "volume").select("site", F.col("abc_class").alias("class"))
    frame = (
        dense.na.fill({"rate": 0.0}).join(t.sites.select("site", "region"), "site").withColumn("working_days", weeks.working_days("week"))
        .join(classes, "site").join(profile.select("site", (F.col("null_share") <= 0.6).alias("good")), "site")
    )
    out = wops.lag_rolling_rows(frame, ["site"], "week", "rate", [(2, 4), (4, 4)], ["mean"])
    return _r(out.drop("rate_lag_4_rolling_mean_4"), 8, "rate_lag_2_rolling_mean_4")


_BUCKETS = [date(1999, 7, 1), date(1999, 10, 1), date(2000, 1, 1)]


@query("kpi15_customer_value", """
SELECT o_custkey, round(sum(o_totalprice) FILTER (WHERE b), 2) AS total, round(avg(o_totalprice) FILTER (WHERE b), 6) AS mean,
       max(o_totalprice) FILTER (WHERE b) AS highest, count(*) FILTER (WHERE b) AS orders,
       CAST(date_diff('day', min(d) FILTER (WHERE b), max(d) FILTER (WHERE b)) AS INTEGER) AS span, """ + ", ".join(
    f"""round(sum(CASE WHEN d >= DATE '{b}' AND d < DATE '{b}' + INTERVAL 3 MONTH THEN o_totalprice ELSE 0 END), 2) AS bucket_{i}"""
    for i, b in enumerate(_BUCKETS, 1)) + """,
       round(sum(CASE WHEN b THEN 0 ELSE o_totalprice END), 2) AS target
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) < DATE '2000-04-01' AS b FROM orders
      WHERE o_orderdate < TIMESTAMP '2000-07-01') x GROUP BY 1 HAVING count(*) FILTER (WHERE b) > 0
""")
def customer_value(t):
    orders = t.orders.where(F.col("o_orderdate") < F.lit("2000-07-01").cast("timestamp")).withColumn(
        "d", F.to_date("o_orderdate"))
    out = ops.customer_value(orders, "o_custkey", "d", "o_totalprice", "o_orderkey", date(2000, 4, 1), _BUCKETS)
    return _r(_r(out, 2, "total", "target", "bucket_1", "bucket_2", "bucket_3"), 6, "mean")


@query("kpi16_distinct_share", """
SELECT n_name, count(DISTINCT c_custkey) AS items, count(DISTINCT c_custkey) / sum(count(DISTINCT c_custkey)) OVER () AS share
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def distinct_share(t):
    buyers = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    named = t.customer.join(buyers, "c_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return ops.distinct_share(named, "n_name", "c_custkey")
