"""Queries: dates, calendars, arithmetic and arrays."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window, functions as F

from aisle.functions import exprs, weeks
from aisle.plans.registry import query

KEYS = ["brand", "region"]
#: Holidays that fall on the same day every year.
VN_DAYS = {"0101": "New Year's Day", "0430": "Reunification Day", "0501": "Labor Day", "0902": "National Day"}
US_DAYS = {"0101": "New Year's Day", "0704": "Independence Day", "1111": "Veterans Day", "1225": "Christmas Day"}

_ORDERS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders) x"


def _orders(t):
    return t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")


@query("dat01_date_parts", f"""
SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(quarter(d) AS INTEGER) AS q, CAST(month(d) AS INTEGER) AS m,
       CAST(day(d) AS INTEGER) AS dd, CAST(dayofweek(d) + 1 AS INTEGER) AS dow, CAST(dayofyear(d) AS INTEGER) AS doy,
       CAST(weekofyear(d) AS INTEGER) AS w
FROM {_ORDERS}
""")
def date_parts(t):
    return _orders(t).select(
        "o_orderkey", F.year("d").alias("y"), F.quarter("d").alias("q"), F.month("d").alias("m"),
        F.dayofmonth("d").alias("dd"), F.dayofweek("d").alias("dow"), F.dayofyear("d").alias("doy"),
        F.weekofyear("d").alias("w"))


@query("dat02_iso_yearweek", f"""
SELECT o_orderkey, CAST(isoyear(d) * 100 + weekofyear(d) AS INTEGER) AS yearweek,
       CAST(date_trunc('week', d) AS DATE) AS monday, CAST(date_trunc('week', d) AS DATE) + 3 AS thursday
FROM {_ORDERS}
""")
def iso_yearweek(t):
    yearweek = _orders(t).select("o_orderkey", weeks.iso_yearweek("d").alias("yearweek"))
    return yearweek.select("*", weeks.yearweek_to_date("yearweek").alias("monday"),
                           weeks.yearweek_to_date("yearweek", 4).alias("thursday"))


@query("dat03_simple_yearweek", f"""
SELECT CAST(year(d) * 100 + ceil(dayofyear(d) / 7.0) AS INTEGER) AS yearweek, count(*) AS orders,
       round(sum(o_totalprice), 2) AS value
FROM {_ORDERS} GROUP BY 1
""")
def simple_yearweek(t):
    return _orders(t).groupBy(weeks.simple_yearweek("d").alias("yearweek")).agg(
        F.count("d").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("dat04_calendar_yearweek", f"""
SELECT o_orderkey, CAST(CASE WHEN month(d) = 1 AND weekofyear(d) >= 52 THEN (year(d) - 1) * 100 + weekofyear(d)
                        ELSE year(d) * 100 + weekofyear(d) END AS INTEGER) AS yearweek
FROM {_ORDERS}
""")
def calendar_yearweek(t):
    return _orders(t).select("o_orderkey", weeks.calendar_yearweek("d").alias("yearweek"))


@query("dat05_yearweek_to_date", """
SELECT brand, region, yearweek, week + 3 AS thursday, week + 6 AS sunday FROM v_weekly
""")
def yearweek_to_date(t):
    return t.weekly.select(*KEYS, "yearweek", weeks.yearweek_to_date("yearweek", 4).alias("thursday"),
                           weeks.yearweek_to_date("yearweek", 7).alias("sunday"))


@query("dat06_yearweek_shift", """
SELECT brand, region, yearweek, CAST(date_diff('day', week, DATE '2001-12-31') // 7 AS INTEGER) AS weeks_to_end,
       CAST(isoyear(week + 70) * 100 + weekofyear(week + 70) AS INTEGER) AS ten_weeks_later
FROM v_weekly
""")
def yearweek_shift(t):
    return t.weekly.select(
        *KEYS, "yearweek", weeks.yearweek_diff(F.lit(200201), "yearweek").alias("weeks_to_end"),
        weeks.yearweek_shift("yearweek", 10).alias("ten_weeks_later"))


@query("dat07_period_table", f"""
WITH p AS (SELECT * FROM (VALUES
  ('yesterday', DATE '2000-03-30', DATE '2000-03-30'), ('previous_day', DATE '2000-03-29', DATE '2000-03-29'),
  ('last_7_days', DATE '2000-03-24', DATE '2000-03-30'), ('previous_7_days', DATE '2000-03-17', DATE '2000-03-23'),
  ('last_30_days', DATE '2000-03-01', DATE '2000-03-30'), ('previous_30_days', DATE '2000-01-31', DATE '2000-02-29'),
  ('month_to_date', DATE '2000-03-01', DATE '2000-03-30'),
  ('previous_month_to_date', DATE '2000-02-01', DATE '2000-02-29')) v(period, start_date, end_date))
SELECT period, start_date, end_date, count(d) AS orders
FROM p LEFT JOIN {_ORDERS} ON d BETWEEN start_date AND end_date GROUP BY 1, 2, 3
""")
def period_table(t):
    booked = _orders(t).select(F.explode(weeks.periods_of("d", date(2000, 3, 31))).alias("p")).groupBy(
        "p.period").agg(F.count("p").alias("orders"))
    return weeks.period_table(t.spark, date(2000, 3, 31)).join(booked, "period", "left").na.fill({"orders": 0})


@query("dat08_calendar", f"""
SELECT c.date, CAST(year(c.date) AS INTEGER) AS year, CAST(quarter(c.date) AS INTEGER) AS quarter,
       CAST(month(c.date) AS INTEGER) AS month, CAST(day(c.date) AS INTEGER) AS day,
       CAST(dayofweek(c.date) + 1 AS INTEGER) AS dayofweek, CAST(dayofyear(c.date) AS INTEGER) AS dayofyear,
       CAST(weekofyear(c.date) AS INTEGER) AS weekofyear,
       CAST(CASE WHEN month(c.date) = 1 AND weekofyear(c.date) >= 52 THEN (year(c.date) - 1) * 100 + weekofyear(c.date)
            ELSE year(c.date) * 100 + weekofyear(c.date) END AS INTEGER) AS yearweek,
       dayofweek(c.date) IN (0, 6) AS is_weekend, day(c.date) = 1 AS is_month_start,
       c.date = last_day(c.date) AS is_month_end, day(c.date) = 1 AND month(c.date) IN (1, 4, 7, 10) AS is_quarter_start,
       c.date = last_day(c.date) AND month(c.date) IN (3, 6, 9, 12) AS is_quarter_end,
       dayofyear(c.date) = 1 AS is_year_start, day(c.date) = 31 AND month(c.date) = 12 AS is_year_end,
       dayofyear(make_date(CAST(year(c.date) AS BIGINT), 12, 31)) = 366 AS is_leap_year,
       CASE WHEN month(c.date) BETWEEN 2 AND 4 THEN 'spring' WHEN month(c.date) BETWEEN 5 AND 7 THEN 'summer'
            WHEN month(c.date) BETWEEN 8 AND 10 THEN 'autumn' ELSE 'winter' END AS season,
       strftime(c.date, '%m%d') IN ('0101', '0430', '0501', '0902') AS is_holiday, coalesce(o.orders, 0) AS orders
FROM v_days c LEFT JOIN (SELECT d, count(*) AS orders FROM {_ORDERS} GROUP BY d) o ON c.date = o.d
""")
def calendar(t):
    orders = _orders(t).groupBy(F.col("d").alias("date")).agg(F.count("d").alias("orders"))
    return weeks.calendar(t.spark, *t.span).join(orders, "date", "left").na.fill({"orders": 0})


def _holiday_sql(names):
    quoted = {k: v.replace("'", "''") for k, v in names.items()}
    return "CASE strftime(d, '%m%d') " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + " ELSE 'Non-Holiday' END"


@query("dat09_holidays", f"""
SELECT o_orderkey, {_holiday_sql(VN_DAYS)} AS vn_holiday, {_holiday_sql(US_DAYS)} AS us_holiday, d AS lunar_date,
       CAST(year(d) AS INTEGER) AS lunar_year, CAST(month(d) AS INTEGER) AS lunar_month,
       CAST(day(d) AS INTEGER) AS lunar_day
FROM {_ORDERS}
""")
def holidays(t):
    # The lunar date is converted and converted back, so its parts are those of the solar date.
    return _orders(t).select(
        "o_orderkey", weeks.mapped_holiday("d", VN_DAYS).alias("vn_holiday"),
        weeks.mapped_holiday("d", US_DAYS).alias("us_holiday"), F.col("d").alias("lunar_date"),
        F.year("d").alias("lunar_year"), F.month("d").alias("lunar_month"), F.dayofmonth("d").alias("lunar_day"))


_RULES = [("US", "Memorial Day", 5, 1, -1), ("US", "Labor Day", 9, 1, 1), ("US", "Thanksgiving", 11, 4, 4)]


def _rule_sql(country, name, month, weekday, nth):
    first = f"make_date(y, {month}, 1)"
    day = (f"{first} + CAST(({weekday} - isodow({first}) + 7) % 7 + {7 * (nth - 1)} AS INTEGER)" if nth > 0 else
           f"last_day({first}) - CAST((isodow(last_day({first})) - {weekday} + 7) % 7 + {7 * (-nth - 1)} AS INTEGER)")
    return f"SELECT CAST({day} AS DATE) AS date, '{country}' AS country, '{name}' AS name, TRUE AS movable FROM years"


def _fixed_sql(country, names):
    return " UNION ALL ".join(
        f"SELECT make_date(y, {int(k[:2])}, {int(k[2:])}), '{country}', '{v.replace(chr(39), chr(39) * 2)}', FALSE FROM years"
        for k, v in names.items())


@query("dat09_holiday_orders", f"""
WITH years AS (SELECT DISTINCT CAST(year(d) AS BIGINT) AS y FROM {_ORDERS}),
h AS ({" UNION ALL ".join(_rule_sql(*r) for r in _RULES)} UNION ALL {_fixed_sql("VN", VN_DAYS)} UNION ALL {_fixed_sql("US", US_DAYS)})
SELECT h.country, h.name, h.movable, h.date, count(*) AS orders, round(sum(o_totalprice), 2) AS value
FROM {_ORDERS} JOIN h ON x.d = h.date GROUP BY ALL
""")
def holiday_orders(t):
    """Orders on fixed and movable holidays of two countries."""
    orders = _orders(t)
    movable = [(c, n, weeks.nth_weekday(F.col("year"), m, w, nth)) for c, n, m, w, nth in _RULES]
    fixed = [(c, n, code) for c, names in (("VN", VN_DAYS), ("US", US_DAYS)) for code, n in names.items()]
    days = weeks.holiday_dimension(orders.select(F.year("d").alias("year")), fixed, movable)
    return orders.join(days, F.col("d") == F.col("date")).groupBy("country", "name", "movable", "date").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("dat10_half_week", f"""
SELECT CAST(date_trunc('week', d) AS DATE) AS week,
       CASE WHEN isodow(d) <= 3 THEN 'first_half' ELSE 'last_half' END AS half_week,
       count(*) AS orders, round(sum(o_totalprice), 2) AS value
FROM {_ORDERS} GROUP BY 1, 2
""")
def half_week(t):
    return _orders(t).groupBy(weeks.week_start("d").alias("week"), weeks.half_week("d").alias("half_week")).agg(
        F.count("d").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value"))


_PROMO_WEEKS = """
SELECT scheme, product, start_date, end_date, CAST(w AS DATE) AS week
FROM v_promotions, unnest(generate_series(date_trunc('week', start_date) - INTERVAL {pad} DAY,
     date_trunc('week', end_date) + INTERVAL {pad} DAY, INTERVAL 7 DAY)) u(w)
"""


def _promo_weeks(t, pad):
    first = F.date_sub(F.trunc("start_date", "week"), pad)
    last = F.date_add(F.trunc("end_date", "week"), pad)
    return t.promotions.select(
        "scheme", "product", "start_date", "end_date",
        F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("week"))


def _flag_sql():
    out = ["CAST(date_trunc('week', start_date) = date_trunc('week', end_date) AS INTEGER) AS start_end_same_week"]
    for n in ("start", "end"):
        here = f"date_trunc('week', {n}_date) = week"
        block = f"(day({n}_date) - 1) // 7 + 1"
        at = f"weekofyear({n}_date) % 13"
        out += [
            f"CAST({here} AS INTEGER) AS {n}_current_week",
            f"CAST({here} AND {block} = 1 AS INTEGER) AS {n}_first_week_of_month",
            f"CAST({here} AND {block} > 3 AS INTEGER) AS {n}_last_week_of_month",
            f"CAST({here} AND {at} = 1 AS INTEGER) AS {n}_first_week_of_quarter",
            f"CAST({here} AND {at} = 0 AS INTEGER) AS {n}_last_week_of_quarter",
        ]
    days = "(date_diff('day', start_date, end_date) + 1)"
    return ", ".join([
        *out, f"CAST({days} < 8 AS INTEGER) AS duration_1_week",
        f"CAST({days} BETWEEN 8 AND 14 AS INTEGER) AS duration_2_weeks",
        f"CAST({days} < 31 AS INTEGER) AS duration_under_1_month",
        f"CAST({days} > 30 AS INTEGER) AS duration_over_1_month"])


@query("dat11_start_end_flags", f"""
SELECT scheme, week, {_flag_sql()} FROM ({_PROMO_WEEKS.format(pad=0)}) z
""")
def start_end_flags(t):
    return _promo_weeks(t, 0).select("scheme", "week", *weeks.start_end_flags("start_date", "end_date", "week"))


def _distance_sql():
    out = []
    for n in ("start", "end"):
        days = f"date_diff('day', {n}_date, week)"
        for label, low, high in (("next_week", -7, -1), ("next_2_weeks", -14, -8), ("last_week", 1, 7),
                                 ("last_2_weeks", 8, 14)):
            out.append(f"CAST(sum(CASE WHEN {days} BETWEEN {low} AND {high} THEN 1 ELSE 0 END) AS BIGINT) AS {n}_{label}")
    return ", ".join(out)


@query("dat12_distance_flags", f"""
SELECT product, week, {_distance_sql()} FROM ({_PROMO_WEEKS.format(pad=14)}) z GROUP BY 1, 2
""")
def distance_flags(t):
    names = [f"{n}_{k}" for n in ("start", "end") for k in ("next_week", "next_2_weeks", "last_week", "last_2_weeks")]
    flagged = _promo_weeks(t, 14).select("product", "week", *weeks.distance_flags("week", "start_date", "end_date"))
    return flagged.groupBy("product", "week").agg(*[F.sum(n).alias(n) for n in names])


def _cyclic_sql(angle, name):
    return ", ".join(f"round({f}(({angle})), 9) + 0.0::DOUBLE AS {name}_{f}" for f in ("sin", "cos"))


@query("dat13_cyclic", f"""
SELECT o_orderkey, {_cyclic_sql("(day(d) - 1) * 2 * pi() / 31", "day")},
       {_cyclic_sql("(month(d) - 1) * 2 * pi() / 12", "month")}, {_cyclic_sql("weekofyear(d) * 2 * pi() / 52", "week")}
FROM {_ORDERS}
""")
def cyclic(t):
    frame = _orders(t).select(
        "o_orderkey", *weeks.cyclic(F.dayofmonth("d") - 1, 31, "day"), *weeks.cyclic(F.month("d") - 1, 12, "month"),
        *weeks.cyclic(F.weekofyear("d"), 52, "week"))
    # Adding 0 turns a rounded negative zero into zero.
    return frame.select("o_orderkey", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in frame.columns[1:]])


@query("dat14_week_of_month", f"""
SELECT o_orderkey, CAST((day(d) - 1) // 7 + 1 AS INTEGER) AS week_of_month,
       CAST(date_diff('day', CAST(date_trunc('quarter', d) AS DATE), d) // 7 + 1 AS INTEGER) AS week_of_quarter
FROM {_ORDERS}
""")
def week_of_month(t):
    return _orders(t).select("o_orderkey", weeks.week_of_month("d").alias("week_of_month"),
                             weeks.week_of_quarter("d").alias("week_of_quarter"))


@query("dat15_month_windows", f"""
SELECT o_orderkey, CAST(date_trunc('month', d) AS DATE) AS month_start, last_day(d) AS month_end, d - 7 AS l1w_start,
       CAST(d - INTERVAL 3 MONTH AS DATE) AS l3m_start, CAST(d - INTERVAL 6 MONTH AS DATE) AS l6m_start,
       CAST(d - INTERVAL 12 MONTH AS DATE) AS same_date_last_year
FROM {_ORDERS}
""")
def month_windows(t):
    return _orders(t).select(
        "o_orderkey", F.trunc("d", "month").alias("month_start"), F.last_day("d").alias("month_end"),
        F.date_sub("d", 7).alias("l1w_start"), F.add_months("d", -3).alias("l3m_start"),
        F.add_months("d", -6).alias("l6m_start"), F.add_months("d", -12).alias("same_date_last_year"))


@query("mth01_guarded_math", """
SELECT brand, region, yearweek, abs(qty - 100) AS gap, ceil(qty / 7) AS boxes, round(gsv, 0) AS gsv_rounded,
       qty % 7 AS rest, CASE WHEN return_qty = 0 THEN 0 ELSE qty / return_qty END AS qty_per_return
FROM v_weekly
""")
def guarded_math(t):
    return t.weekly.select(
        *KEYS, "yearweek", F.abs(F.col("qty") - 100).alias("gap"), F.ceil(F.col("qty") / 7).cast("double").alias("boxes"),
        F.round("gsv", 0).alias("gsv_rounded"), (F.col("qty") % 7).alias("rest"),
        exprs.safe_div("qty", "return_qty").alias("qty_per_return"))


_PROBA = """(SELECT doc_id, 1.0::DOUBLE / (1 + n_chars % 7) AS oral_proba, 1.0::DOUBLE / (1 + n_chars % 5) AS deo_proba,
             1.0::DOUBLE / (1 + n_chars % 3) AS hair_proba FROM documents) s"""


@query("mth02_best_probability", f"""
SELECT doc_id, greatest(oral_proba, deo_proba, hair_proba) AS best_proba FROM {_PROBA}
WHERE greatest(oral_proba, deo_proba, hair_proba) >= 0.7
""")
def best_probability(t):
    scored = t.documents.select("doc_id", *[
        (F.lit(1.0) / (1 + F.col("n_chars") % m)).alias(f"{n}_proba")
        for n, m in (("oral", 7), ("deo", 5), ("hair", 3))])
    best = F.greatest("oral_proba", "deo_proba", "hair_proba")
    return scored.select("doc_id", best.alias("best_proba")).where("best_proba >= 0.7")


_SPEC = "PARTITION BY brand, region ORDER BY week_no"


@query("mth03_row_median", f"""
SELECT brand, region, yearweek, (SELECT median(v) FROM unnest([a, b, c, qty]) u(v)) AS row_median,
       (SELECT avg(v) FROM unnest([a, b, c, qty]) u(v)) AS row_mean
FROM (SELECT brand, region, yearweek, qty, lag(qty, 1) OVER w AS a, lag(qty, 2) OVER w AS b, lag(qty, 52) OVER w AS c
      FROM v_weekly WINDOW w AS ({_SPEC})) x
""")
def row_median(t):
    spec = Window.partitionBy(*KEYS).orderBy("week_no")
    cols = [F.lag("qty", n).over(spec).alias(f"_{n}") for n in (1, 2, 52)]
    frame = t.weekly.select(*KEYS, "yearweek", "qty", *cols)
    names = ["_1", "_2", "_52", "qty"]
    return frame.select(*KEYS, "yearweek", exprs.row_median(*names).alias("row_median"),
                        exprs.row_mean(*names).alias("row_mean"))


@query("mth04_scale", """
SELECT brand, region, yearweek, (qty - min(qty) OVER ()) / (max(qty) OVER () - min(qty) OVER ()) AS min_max,
       (qty - min(qty) OVER k) / nullif(max(qty) OVER k - min(qty) OVER k, 0) AS min_max_key,
       round((qty - avg(qty) OVER k) / nullif(stddev_pop(qty) OVER k, 0), 8) AS standard_key
FROM v_weekly WINDOW k AS (PARTITION BY brand, region)
""")
def scale(t):
    total = t.weekly.agg(F.min("qty").alias("_low"), F.max("qty").alias("_high"))
    key = Window.partitionBy(*KEYS)
    low, high = F.min("qty").over(key), F.max("qty").over(key)
    return exprs.beside(t.weekly.select(*KEYS, "yearweek", "qty"), total).select(
        *KEYS, "yearweek", exprs.ratio(F.col("qty") - F.col("_low"), F.col("_high") - F.col("_low")).alias("min_max"),
        exprs.ratio(F.col("qty") - low, high - low).alias("min_max_key"),
        F.round(exprs.ratio(F.col("qty") - F.avg("qty").over(key), F.stddev_pop("qty").over(key)), 8).alias("standard_key"))


@query("mth05_fixed_bins", """
SELECT CASE WHEN rate IS NULL THEN 'null' WHEN rate = 0 THEN '0' WHEN rate = 1 THEN '1'
            WHEN rate < 0 OR rate > 1 THEN 'outside'
            ELSE concat('<=', printf('%.1f', ceil(round(rate * 10, 6)) / 10)) END AS bin, count(*) AS weeks
FROM (SELECT CAST(round(CAST(CAST(1 - abs(return_qty - promo_qty) / nullif(promo_qty, 0) AS VARCHAR) AS DECIMAL(38, 20)), 2)
             AS DOUBLE) AS rate FROM v_weekly) x GROUP BY 1
""")
def fixed_bins(t):
    rate = F.round(1 - exprs.ratio(F.abs(F.col("return_qty") - F.col("promo_qty")), "promo_qty"), 2)
    return t.weekly.select(exprs.decile_edge_bin(rate).alias("bin")).groupBy("bin").agg(F.count("bin").alias("weeks"))


@query("mth06_value_tiers", """
SELECT o_custkey, CASE WHEN v >= 4000000 THEN 'A' WHEN v >= 3000000 THEN 'B' WHEN v >= 2000000 THEN 'C'
       WHEN v >= 1000000 THEN 'D' ELSE 'E' END AS tier
FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) x
""")
def value_tiers(t):
    steps = [(4e6, "A"), (3e6, "B"), (2e6, "C"), (1e6, "D")]
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v")).select(
        "o_custkey", exprs.tier("v", steps, "E").alias("tier"))


@query("mth07_transforms", """
SELECT brand, region, yearweek, round((sqrt(qty) - 1) / 0.5, 8) AS boxcox,
       round(power((sqrt(qty) - 1) / 0.5 * 0.5 + 1, 2), 6) AS restored, round(ln(1 + qty), 8) AS logged
FROM v_weekly
""")
def transforms(t):
    boxed = exprs.boxcox_half("qty")
    return t.weekly.select(
        *KEYS, "yearweek", F.round(boxed, 8).alias("boxcox"),
        F.round(exprs.boxcox_half_inverse(boxed), 6).alias("restored"), F.round(F.log1p("qty"), 8).alias("logged"))


@query("mth08_impute", """
WITH j AS (SELECT d.doc_id, d.source, l.quality, CASE WHEN l.toxic = 1 THEN NULL ELSE d.n_chars END AS n_chars
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT quality FROM (SELECT quality, count(*) AS n FROM j WHERE quality IS NOT NULL GROUP BY 1) c
      ORDER BY n DESC, quality LIMIT 1),
a AS (SELECT avg(n_chars) AS mean_chars FROM j)
SELECT doc_id, coalesce(quality, (SELECT quality FROM m)) AS quality,
       round(coalesce(n_chars, (SELECT mean_chars FROM a)), 6) AS n_chars
FROM j
""")
def impute(t):
    joined = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, None).otherwise(F.col("n_chars")).alias("n_chars"))
    mode = joined.where("quality is not null").groupBy("quality").agg(F.count("quality").alias("n")).orderBy(
        F.desc("n"), "quality").limit(1).select(F.col("quality").alias("_mode"))
    mean = joined.agg(F.avg("n_chars").alias("_mean"))
    return exprs.beside(exprs.beside(joined, mode), mean).select(
        "doc_id", F.coalesce("quality", "_mode").alias("quality"),
        F.round(F.coalesce("n_chars", "_mean"), 6).alias("n_chars"))


@query("arr01_expand_dates", """
SELECT scheme, mechanic, CAST(d AS DATE) AS date
FROM v_promotions, unnest(generate_series(CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP), INTERVAL 1 DAY)) u(d)
""")
def expand_dates(t):
    return t.promotions.select(
        "scheme", "mechanic", F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("date"))


@query("arr02_set_size", """
SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities, max(o_orderpriority) AS last_priority
FROM orders GROUP BY 1
""")
def set_size(t):
    known = F.sort_array(F.collect_set("o_orderpriority"))
    return t.orders.groupBy("o_custkey").agg(
        F.size(known).cast("bigint").alias("priorities"), F.element_at(known, -1).alias("last_priority"))


@query("arr03_guarded_sequence", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(abs(date_diff('month', date_trunc('month', l_shipdate),
       date_trunc('month', o_orderdate))) + 1 AS INTEGER) AS months
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def guarded_sequence(t):
    shipped, ordered = F.trunc("l_shipdate", "month"), F.trunc("o_orderdate", "month")
    span = F.sequence(F.least(shipped, ordered), F.greatest(shipped, ordered), F.expr("interval 1 month"))
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size(span).alias("months"))
