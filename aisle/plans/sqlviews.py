"""SQL text of the retail views, for the SQL side of the registered queries."""

from __future__ import annotations

_WEEKLY = """
SELECT brand, region, week, qty, gsv, lines, promo_qty, return_qty,
       CAST(date_diff('day', DATE '1970-01-05', week) // 7 AS INTEGER) AS week_no,
       CAST(isoyear(week) * 100 + weekofyear(week) AS INTEGER) AS yearweek
FROM (SELECT p.brand, s.region, CAST(date_trunc('week', x.date) AS DATE) AS week, sum(x.qty) AS qty,
             round(sum(x.gsv), 4) AS gsv, count(*) AS lines,
             sum(CASE WHEN x.discount >= 0.08 THEN x.qty ELSE 0 END) AS promo_qty,
             sum(CASE WHEN x.return_flag = 'R' THEN x.qty ELSE 0 END) AS return_qty
      FROM {lines} x JOIN v_products p ON x.product = p.product JOIN v_sites s ON x.site = s.site
      GROUP BY 1, 2, 3) g
"""

VIEWS: dict[str, str] = {
    "v_sites": """
SELECT s_suppkey AS site, s_nationkey AS distributor, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "v_products": """
SELECT p_partkey AS product, p_name AS dp_name, p_brand AS brand, p_type AS category,
       p_size AS pack_size, p_retailprice AS price FROM part
""",
    "v_outlets": """
SELECT c_custkey AS outlet, c_name AS outlet_name, c_mktsegment AS channel,
       c_nationkey AS nation_key, c_acctbal AS balance FROM customer
""",
    "v_migration": """
SELECT c_custkey AS prev_outlet, c_custkey + 1 AS new_outlet FROM customer WHERE c_acctbal < 0
""",
    "v_lines": """
SELECT CAST(l_shipdate AS DATE) AS date, l_partkey AS product, l_suppkey AS site, l_quantity AS qty,
       round(l_extendedprice * (1 - l_discount), 4) AS gsv, l_discount AS discount,
       l_returnflag AS return_flag, l_orderkey AS invoice
FROM lineitem
""",
    "v_sales": """
SELECT x.product, x.site, x.qty, x.gsv, x.discount, x.return_flag, x.invoice, x.date AS ship_date,
       CAST(o_orderdate AS DATE) AS date, o_custkey AS outlet, o_orderstatus AS status,
       o_orderpriority AS priority
FROM v_lines x JOIN orders ON x.invoice = o_orderkey
""",
    "v_weekly": _WEEKLY.format(lines="v_lines"),
    "v_weekly_secondary": _WEEKLY.format(lines="v_sales"),
    "v_daily": """
SELECT brand, date, sum(qty) AS qty, round(sum(gsv), 4) AS gsv, count(*) AS lines
FROM v_lines x JOIN v_products p ON x.product = p.product GROUP BY brand, date
""",
    "v_promotions": """
SELECT o_orderkey AS scheme, o_orderpriority AS mechanic, o_orderstatus AS status, o_custkey AS outlet,
       CAST(o_orderdate AS DATE) AS start_date,
       CAST(o_orderdate AS DATE) + CAST(o_orderkey % 21 AS INTEGER) AS end_date, b.discount, b.product
FROM orders JOIN (SELECT l_orderkey, max(l_discount) AS discount, min(l_partkey) AS product
                  FROM lineitem GROUP BY 1) b ON o_orderkey = b.l_orderkey
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
""",
    "v_traffic": """
SELECT CAST(CAST(ts AS DATE) - INTERVAL 286 MONTH AS DATE) AS date,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS site,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS visitors,
       count(*) FILTER (WHERE event_type = 'view') AS views,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS cart_users,
       count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers,
       round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS web_gmv
FROM events GROUP BY 1, 2
""",
    "v_forecasts": """
SELECT * FROM (SELECT brand, region, week_no, yearweek, qty AS actual,
       round(max(qty) OVER (w RANGE BETWEEN 52 PRECEDING AND 52 PRECEDING) * 1.05::DOUBLE, 2) AS fc_year,
       max(qty) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fc_week,
       round(avg(qty) OVER (w RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), 2) AS fc_mean
FROM v_weekly WINDOW w AS (PARTITION BY brand, region ORDER BY week_no)) f
WHERE fc_year IS NOT NULL AND fc_week IS NOT NULL AND fc_mean IS NOT NULL
""",
    "v_product_weekly": """
SELECT product, CAST(date_diff('day', DATE '1970-01-05', date) // 7 AS INTEGER) AS week_no, sum(qty) AS qty
FROM v_lines GROUP BY 1, 2
""",
    "v_scores": """
SELECT d.doc_id, d.source, d.lang, round(1000.0::DOUBLE / (1000.0::DOUBLE + d.n_chars), 3) AS score, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
    "v_plan": """
SELECT brand, region, w.week, w.week_no, w.yearweek, qty, working_days,
       CASE WHEN working_days <> 0 THEN qty / working_days ELSE 0 END AS daily,
       CAST(promo_qty > qty * 0.35::DOUBLE AS INTEGER) AS green, w.week + 3 AS anchor
FROM v_weekly w JOIN v_full_weeks c ON w.week = c.week
""",
    "v_pri_promo": """
SELECT s.region AS category, p.brand AS dp, p.category AS material, CAST(date_trunc('week', x.date) AS DATE) AS week,
       sum(x.qty) AS pri_sales
FROM v_lines x JOIN v_products p ON x.product = p.product JOIN v_sites s ON x.site = s.site
WHERE x.discount >= 0.08 GROUP BY 1, 2, 3, 4
""",
    "v_sec_promo": """
SELECT s.region AS category, p.brand AS dp, p.category AS material, CAST(date_trunc('week', x.date) AS DATE) AS week,
       sum(x.qty) AS sec_sales
FROM v_sales x JOIN v_products p ON x.product = p.product JOIN v_sites s ON x.site = s.site
WHERE x.discount >= 0.08 GROUP BY 1, 2, 3, 4
""",
    "v_banded": """
SELECT b.category, b.dp, b.material, b.week, coalesce(b.pri_sales, 0) AS pri_sales, coalesce(b.sec_sales, 0) AS sec_sales,
       coalesce(w.qty, 0) AS pri_sales_dp, l.baseline,
       CAST(date_diff('day', DATE '1970-01-05', b.week) // 7 AS INTEGER) AS week_no
FROM (SELECT * FROM v_pri_promo FULL JOIN v_sec_promo USING (category, dp, material, week)) b
LEFT JOIN v_weekly w ON b.category = w.region AND b.dp = w.brand AND b.week = w.week
JOIN (SELECT region, brand, quantile_cont(qty, 0.5) AS baseline FROM v_weekly GROUP BY 1, 2) l
ON b.category = l.region AND b.dp = l.brand
""",
    "v_deals": """
SELECT scheme, x.product, p.brand, CAST(strftime(start_date, '%Y%m%d') AS INTEGER) AS start_date,
       CAST(strftime(end_date, '%Y%m%d') AS INTEGER) AS orig_end_date,
       CASE WHEN status = 'P' THEN CAST(strftime(end_date - 3, '%Y%m%d') AS INTEGER) ELSE 0 END AS stop_date,
       CASE WHEN status = 'O' THEN 'CANCELLED' ELSE 'OPEN' END AS deal_status,
       CASE WHEN mechanic = '1-URGENT' AND discount >= 0.08 THEN 'PERCENTAGE' WHEN mechanic = '1-URGENT' THEN 'VALUE'
            WHEN discount >= 0.08 THEN 'U GIFT' ELSE 'NON-U GIFT' END AS mechanic_type,
       CASE p.category WHEN 'PROMO' THEN 'VND' WHEN 'SMALL' THEN 'SU' WHEN 'LARGE' THEN 'CS' ELSE 'PC' END AS min_buy_uom,
       CASE p.category WHEN 'ECONOMY' THEN 'SU' WHEN 'MEDIUM' THEN 'CS' ELSE 'PC' END AS gift_uom,
       CAST(pack_size AS DOUBLE) AS min_buy, discount * 100 AS pct_discount, price * discount AS val_discount,
       discount * 100 AS gift_qty, price AS price_pc, price * 6 AS price_su, price * 24 AS price_cs,
       price / 2 AS gift_price_pc, price * 3 AS gift_price_su, price * 12 AS gift_price_cs
FROM v_promotions x JOIN v_products p ON x.product = p.product
""",
    "v_span": """
SELECT CAST(date_trunc('year', min(low)) AS DATE) AS low, make_date(CAST(year(max(high)) AS BIGINT), 12, 31) AS high
FROM (SELECT CAST(min(l_shipdate) AS DATE) AS low, CAST(max(l_shipdate) AS DATE) AS high FROM lineitem
      UNION ALL SELECT CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) + 20 FROM orders) x
""",
    "v_full_weeks": """
SELECT CAST(date_trunc('week', d) AS DATE) AS week, CAST(count(*) FILTER (WHERE dayofweek(d) <> 0
       AND strftime(d, '%m%d') NOT IN ('0101', '0430', '0501', '0902')) AS INTEGER) AS working_days
FROM v_span, unnest(generate_series(CAST(date_trunc('week', low) AS TIMESTAMP), CAST(CAST(date_trunc('week', high) AS DATE) + 6 AS TIMESTAMP), INTERVAL 1 DAY)) g(d)
GROUP BY 1
""",
    "v_days": """
SELECT CAST(d AS DATE) AS date
FROM v_span, unnest(generate_series(CAST(low AS TIMESTAMP), CAST(high AS TIMESTAMP), INTERVAL 1 DAY)) g(d)
""",
    "v_weeks": """
SELECT CAST(date_trunc('week', date) AS DATE) AS week,
       CAST(date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', date) AS DATE)) // 7 AS INTEGER) AS week_no,
       CAST(isoyear(date_trunc('week', date)) * 100 + weekofyear(date_trunc('week', date)) AS INTEGER) AS yearweek,
       CAST(count(*) FILTER (WHERE dayofweek(date) <> 0
            AND strftime(date, '%m%d') NOT IN ('0101', '0430', '0501', '0902')) AS INTEGER) AS working_days
FROM v_days GROUP BY 1, 2, 3
""",
}
