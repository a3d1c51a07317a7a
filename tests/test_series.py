"""Hand-made series with known answers."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aisle.functions import weeks, windows as win
from aisle.operators import evaluation, promotion, quality, timeseries as ts, windows as ops
from aisle.sources.retail import Tables


def test_three_week_systems(spark):
    days = [date(2020, 12, 31), date(2021, 1, 1), date(2021, 1, 3), date(2021, 1, 4)]
    out = spark.createDataFrame([(d,) for d in days], "d date").select(
        weeks.iso_yearweek("d").alias("iso"), weeks.simple_yearweek("d").alias("simple"),
        weeks.calendar_yearweek("d").alias("calendar")).collect()
    assert [r.iso for r in out] == [202053, 202053, 202053, 202101]
    assert [r.simple for r in out] == [202053, 202101, 202101, 202101]
    assert [r.calendar for r in out] == [202053, 202053, 202053, 202101]


def test_yearweek_arithmetic_over_a_long_year(spark):
    row = spark.range(1).select(
        weeks.yearweek_diff(F.lit(202101), F.lit(202052)).alias("gap"),
        weeks.yearweek_shift(F.lit(202052), 2).alias("shifted"), weeks.yearweek_to_date(F.lit(202053), 4).alias("day")).first()
    assert (row.gap, row.shifted, row.day) == (2, 202101, date(2020, 12, 31))


def test_period_table_clamps_the_previous_month(spark):
    rows = {r.period: (r.start_date, r.end_date) for r in weeks.period_table(spark, date(2024, 3, 31)).collect()}
    assert rows["month_to_date"] == (date(2024, 3, 1), date(2024, 3, 30))
    assert rows["previous_month_to_date"] == (date(2024, 2, 1), date(2024, 2, 29))
    assert rows["last_7_days"] == (date(2024, 3, 24), date(2024, 3, 30))


def test_densify_and_range_rolling(spark):
    rows = [("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 3), 3.0), ("b", date(2024, 1, 2), 5.0)]
    dense = ts.densify(spark.createDataFrame(rows, "k string, d date, q double"), ["k"], "d", ["q"])
    assert [(r.k, r.d.day, r.q) for r in dense.orderBy("k", "d").collect()] == [
        ("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 3.0), ("b", 2, 5.0)]
    spec = win.series(["k"], "n")
    series = spark.createDataFrame([("a", n, float(n)) for n in (1, 2, 3, 5, 6)], "k string, n int, q double")
    out = series.select("n", *win.rolling_range("q", spec, [(1, 2)], ["sum"])).orderBy("n").collect()
    # lag 1 and two periods: the periods n − 3 and n − 2.
    assert [r[1] for r in out] == [None, None, 1.0, 5.0, 3.0]


def test_promo_runs(spark):
    values = [10, 0, 0, 5, 5, 0, 0, 0, 7]
    frame = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "k string, n int, q double")
    out = ops.promo_runs(frame, ["k"], "n", "q").orderBy("n").collect()
    # The fourth row follows two empty rows; from the eighth row on every row does.
    assert [r.run_no for r in out] == [1, 1, 1, 2, 2, 2, 2, 3, 4]


def _baseline(values, green):
    """The two-stage rule in pandas."""
    s, g = pd.Series(values, dtype=float), pd.Series(green)
    yellow = s.where(g == 0)
    ok = pd.Series(1, index=s.index).rolling(26).count() >= 26
    left = yellow.rolling(26, min_periods=1).mean().where(ok)
    right = yellow[::-1].rolling(26, min_periods=1).mean()[::-1].where(ok[::-1].values)
    mean = ((left + right) / 2).fillna(left).fillna(right)
    std = yellow.rolling(26, min_periods=2).std().where(ok)
    s = s.mask(s > mean + std, mean + std).mask(s < mean - std, mean - std)

    def sides(stat):
        a = getattr(s.shift(1).rolling(6), stat)()
        b = getattr(s.shift(-1)[::-1].rolling(6), stat)()[::-1]
        return ((a + b) / 2).fillna(a).fillna(b)

    mean, std = sides("mean"), sides("std")
    return s.mask(s > mean + std, mean + std).mask(s < mean - std, mean - std)


def test_baseline_clean_against_pandas(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(5, 40, 60).astype(float)
    green = np.zeros(60, dtype=int)
    green[[20, 21, 45]] = 1
    values[[20, 21, 45]] *= 4
    frame = spark.createDataFrame(
        [("a", i, float(v), int(g), 6) for i, (v, g) in enumerate(zip(values, green))],
        "k string, n int, daily double, green int, working_days int")
    out = [r.baseline_daily for r in ts.baseline_clean(frame, ["k"], "n").orderBy("n").collect()]
    np.testing.assert_allclose(out, _baseline(values, green).to_numpy(), rtol=1e-9)


def _material(spark, rows):
    return spark.createDataFrame(
        [("c", "d", "m", n, date(2024, 1, 1), p, s, dp, b) for n, p, s, dp, b in rows],
        "category string, dp string, material string, week_no int, week date, pri_sales double, sec_sales double, "
        "pri_sales_dp double, baseline double").withColumn("week", F.expr("date_add(week, week_no * 7)"))


def test_preload_and_shift(spark):
    # Primary shares 0.04, 0.46, 0.45, 0.05: the preload ends in the third week and its first week moves on.
    rows = [(0, 4.0, 2.0, 90.0, 50.0), (1, 46.0, 10.0, 90.0, 50.0), (2, 45.0, 60.0, 90.0, 50.0), (3, 5.0, 40.0, 90.0, 50.0)]
    marked = promotion.preload(promotion.numbered_runs(promotion.uplift(_material(spark, rows))))
    out = marked.orderBy("week_no").collect()
    assert [r.preload_length for r in out] == [3, 3, 3, 0]
    assert {r.preload_sum for r in out} == {95.0}
    shifted = promotion.shift_preload(marked)
    out = shifted.orderBy("week_no").collect()
    assert [r.pri_sales for r in out] == [0.0, 50.0, 45.0, 5.0]
    assert [r.sec_sales for r in out] == [0.0, 12.0, 60.0, 40.0]
    assert [r.preload_length for r in out] == [0, 2, 2, 0]
    post = promotion.postload(shifted).orderBy("week_no").collect()
    assert [(r.week_no, r.postload_length) for r in post] == [(1, 0), (2, 0), (3, 1)]


def test_negative_leading_weeks_move_to_the_first_positive_one(spark):
    rows = [(0, 40.0, 10.0, 20.0, 50.0), (1, 30.0, 10.0, 30.0, 50.0), (2, 30.0, 80.0, 90.0, 50.0)]
    marked = promotion.preload(promotion.numbered_runs(promotion.uplift(_material(spark, rows))))
    out = promotion.shift_preload(marked).orderBy("week_no").collect()
    assert [r.pri_sales for r in out] == [0.0, 0.0, 100.0]
    assert [r.preload_length for r in out] == [0, 0, 1]


def test_interval_overlaps(spark):
    rows = [("a", "x", date(2024, 1, 1), date(2024, 1, 10)), ("a", "y", date(2024, 1, 5), date(2024, 1, 20)),
            ("a", "z", date(2024, 2, 1), date(2024, 2, 5))]
    frame = spark.createDataFrame(rows, "k string, m string, start_date date, end_date date")
    out = quality.interval_overlaps(frame, ["k"], ["m"]).orderBy("m").collect()
    assert [(r.overlap_same, r.overlap_other) for r in out] == [(0, 1), (0, 1), (0, 0)]


def test_contract(spark):
    contract = [quality.Rule("code", "number", "[0-9]+$", nullable=False), quality.Rule("qty", "number", "[0-9]+$", low=1, high=9)]
    frame = spark.createDataFrame([("1", "5"), (None, "5"), ("x", "5"), ("2", "12"), ("3", None)], "code string, qty string")
    out = quality.validate(frame, contract).collect()
    assert [r.summary_check for r in out] == [
        "", "code:missing wrong type", "code:wrong type", "qty:out of range", "qty:out of range"]
    assert [r.fail_case for r in out] == ["", "x", "x", "x", "x"]


def test_recursive_forecast_feeds_its_steps_back(spark):
    frame = spark.createDataFrame([("a", i, float(i)) for i in range(1, 5)], "k string, n int, q double")
    out = ts.recursive_forecast(
        frame, ["k"], "n", "q", [1, 2], 3,
        lambda f, lag: f.withColumn("prediction", F.col(lag[1]) + F.col(lag[2]))).orderBy("step").collect()
    assert [(r.n, r.prediction) for r in out] == [(5, 7.0), (6, 11.0), (7, 18.0)]


def test_map_groups_reports_errors_as_rows(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("c", 2.0), ("c", 3.0), (None, 4.0)], "k string, q double")

    def fn(table):
        values = table.column("q").to_pylist()
        if min(values) < 0:
            raise ValueError("negative")
        return {"q": sorted(values), "n": [len(values)] * len(values)}

    out = sorted(map(tuple, ts.map_groups(frame, ["k"], fn, "q double, n int").collect()), key=str)
    assert out == [("a", 1.0, 1, None), ("b", None, None, "ValueError: negative"), ("c", 2.0, 2, None), ("c", 3.0, 2, None),
                   (None, 4.0, 1, None)]


def test_smoothing_equals_a_plain_loop(spark):
    draw = np.random.default_rng(4)
    series = {k: draw.normal(100, 20, size=n).round(2).tolist() for k, n in (("a", 40), ("b", 3), ("c", 2), ("flat", 1))}
    series |= {"flat": [5.0] * 6, "gap": [1.0, None, 2.0], "nan": [1.0, float("nan"), 2.0]}
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    draw.shuffle(order := np.arange(len(rows)))
    frame = spark.createDataFrame([rows[i] for i in order], "k string, n int, y double")
    out = {r.k: r for r in ts.smoothed(frame, ["k"], "n", "y", [0.9, 0.1, 0.5]).collect()}
    assert len(out) == len(series)
    for k, values in series.items():
        if len(values) < 3 or any(v is None or v != v for v in values):
            assert out[k].alpha is None and out[k].error == (
                "ValueError: 2 of 3 periods" if k == "c" else "ValueError: missing value")
            continue
        best = None
        for alpha in (0.1, 0.5, 0.9):
            level, error = values[0], 0.0
            for v in values[1:]:
                error += (v - level) ** 2
                level += alpha * (v - level)
            if best is None or error < best[0]:
                best = (error, alpha, level)
        assert (out[k].alpha, out[k].periods, out[k].error) == (best[1], len(values), None)
        assert out[k].level == pytest.approx(best[2]) and out[k].mse == pytest.approx(best[0] / (len(values) - 1))


@pytest.mark.parametrize("train", [None, 3])
def test_folds_and_models_of_every_origin(spark, train):
    """Against plain folds and numpy's least squares; the periods have gaps and the rows repeat."""
    draw = np.random.default_rng(6)
    periods = [3, 4, 5, 9, 10, 11, 12, 20, 21]
    rows = [(p, float(x), float(z), float(2 * x - z + e + p)) for p in periods for x, z, e in draw.normal(size=(4, 3))]
    frame = spark.createDataFrame([*rows, (None, 1.0, 1.0, 1.0), (11, None, 1.0, 1.0)], "p int, x double, z double, y double")
    expected, models = set(), {}
    for at in range(train or 2, len(periods) - 2 + 1):
        origin, tests = periods[at], periods[at : at + 2]
        before = periods[max(0, at - train) if train else 0 : at]
        expected |= {(p, origin, "test", i + 1) for i, p in enumerate(tests)}
        expected |= {(p, origin, "train", i - len(before) + 1) for i, p in enumerate(before)}
        known = np.array([r for r in rows if r[0] in before])
        models[origin] = np.linalg.lstsq(np.column_stack([np.ones(len(known)), known[:, 1:3]]), known[:, 3], rcond=None)[0]
    dealt = ts.rolling_folds(frame.select("p").distinct(), "p", 2, train, 2)
    assert {(r.p, r.origin, r.role, r.step) for r in dealt.collect()} == expected
    made = ts.rolling_regression(frame, "p", "y", ["x", "z"], 2, train, 2).collect()
    assert len(made) == 4 * sum(role == "test" for _, _, role, _ in expected)
    for r in made:
        w = models[r.origin]
        assert r.prediction == pytest.approx(w[0] + w[1] * r.x + w[2] * r.z, abs=1e-8)
    assert ts.rolling_folds(frame.where("p < 4"), "p", 2, train).count() == 0


def test_series_split_keeps_order(spark):
    frame = spark.createDataFrame([("a", i, 1.0) for i in range(10)], "k string, n int, q double")
    out = ts.time_split(frame, ["k"], "n", 0.8).orderBy("n").collect()
    assert [r.part for r in out] == ["train"] * 8 + ["test"] * 2


@pytest.mark.parametrize("actual, expected", [(0.0, 1 - 3.0), (4.0, 0.75)])
def test_row_accuracy_guard(spark, actual, expected):
    from aisle.operators.evaluation import row_accuracy

    frame = spark.createDataFrame([(actual, 3.0)], "a double, p double")
    assert frame.select(row_accuracy("a", "p")).first()[0] == pytest.approx(expected)


def test_plan_keeps_weeks_of_any_year(spark, folder):
    tables = Tables(spark, folder)
    weekly = tables.weekly
    expected = weekly.count()
    tables.__dict__["weekly"] = weekly.withColumn("week", F.date_add("week", 7 * 522))
    assert tables.plan.count() == expected
    days = spark.sql("SELECT DATE '2012-04-30' AS week UNION ALL SELECT DATE '1990-01-08'")
    # April 30, May 1 are holidays; Sundays do not count.
    assert {r.n for r in days.select(weeks.working_days("week").alias("n")).collect()} == {4, 6}


def test_diversity_counts_distinct_items_without_sets(spark):
    import random

    draw = random.Random(3)
    rows = [(draw.choice("ab"), draw.randrange(60), draw.choice(["x", "y", "z", "w", None])) for _ in range(150)]
    rows += [("one", 5, None), ("one", 7, "x"), ("one", 7, "x"), ("one", 8, "x"), ("one", 40, "y")]
    frame = spark.createDataFrame(rows, "k string, at int, item string")
    made = ops.diversity(frame, ["k"], "at", "item", [1, 4, 30])
    out = {(r.k, r.at): tuple(r)[2:] for r in made.collect()}
    assert set(out) == {(k, at) for k, at, _ in rows}
    for (k, at), counts in out.items():
        assert counts == tuple(
            len({i for q, p, i in rows if q == k and at - n <= p < at and i is not None}) for n in (1, 4, 30))
    assert "collect_" not in made._jdf.queryExecution().toString()


#: 28 years are the same calendar: weekdays, leap years and ISO weeks repeat.
_DAYS = 7 * 1461
_MOVED = {"week_no": 1461, "first_week": 1461, "origin": 1461, "cutoff": 1461, "yearweek": 2800, "year": 28}
_DATED = ["jn05_complete_dates", "jn09_key_period_grid", "jn13_working_days_between", "dat08_calendar", "ts03_weekly_mart",
          "ts03_monthly_mart", "ts04_daily_average", "ts16_future_frame", "ts17_secondary_to_primary", "ts20_ml_lag_features",
          "ts24_rolling_origin", "ts24_sliding_window", "ts33_seasonal_index", "ts35_holiday_context", "win12_calendar_neighbors",
          "win13_week_order", "win17_forward_fill_limit", "win18_fill_both_ways", "dq07_coverage_profile", "dq07_split_by_quality",
          "kpi14_compliance_features", "prm03_feature_matrix", "jn04_merge_features", "mlj16_time_series_cv"]


@pytest.mark.parametrize("name", _DATED)
def test_calendars_follow_the_data(spark, folder, name):
    """All dates moved by 28 years give the same rows 28 years later: no week or month is lost to a fixed calendar."""
    from aisle.plans.registry import _QUERIES

    tables, moved = Tables(spark, folder), Tables(spark, folder)
    for table, column in (("lineitem", "l_shipdate"), ("orders", "o_orderdate")):
        frame = getattr(tables, table)
        later = F.col(column) + F.make_dt_interval(F.lit(_DAYS))
        moved.__dict__[table] = frame.withColumn(column, later.cast(frame.schema[column].dataType))

    def rows(query, back):
        out = []
        for r in query.collect():
            values = []
            for c, v in r.asDict().items():
                if isinstance(v, date):
                    v = date.fromordinal(v.toordinal() - back * _DAYS)
                elif c in _MOVED and v is not None:
                    v -= back * _MOVED[c]
                values.append((c, round(v, 6) if isinstance(v, float) else v))
            out.append(str(values))
        return sorted(out)

    expected = rows(_QUERIES[name](tables), 0)
    assert expected and rows(_QUERIES[name](moved), 1) == expected


def test_unseen_values_become_columns(spark):
    from aisle.operators import aggregates, kpi

    frame = spark.createDataFrame([("a", "x", 1.0, 1), ("a", "new", 2.0, 2), ("b", None, 4.0, 3)], "k string, v string, qty double, i int")
    out = {r.k: r.asDict() for r in aggregates.pivot_sum(frame, ["k"], "v", F.col("qty"), "q_").collect()}
    assert out["a"] == {"k": "a", "q_new": 2.0, "q_x": 1.0, "q_null": 0.0} and out["b"]["q_null"] == 4.0
    counted = {r.k: tuple(r)[1:] for r in aggregates.onehot_counts(frame, ["k"], "v", "i", "n_").collect()}
    assert counted == {"a": (1, 1, 0), "b": (0, 0, 1)}
    rates = {r.k: r.manual_rate for r in kpi.manual_rate(frame, ["k"], "v", ["x"]).collect()}
    assert rates == {"a": 0.3333, "b": 0.0}
    with pytest.raises(ValueError, match="300 values of id"):
        aggregates.distinct_values(spark.range(300), "id")


def test_movable_holidays(spark):
    import datetime

    years = spark.createDataFrame([(y,) for y in (1999, 2000, 2001, 2024, 2038)], "year int")
    year = F.col("year")
    tet = spark.createDataFrame([("VN", "Tet", date(2001, 1, 23), date(2001, 1, 26))],
                                "country string, name string, start_date date, end_date date")
    rules = [("US", "Thanksgiving", weeks.nth_weekday(year, 11, 4, 4)), ("US", "Memorial Day", weeks.nth_weekday(year, 5, 1, -1)),
             ("DE", "Easter", weeks.easter_sunday(year))]
    out = weeks.holiday_dimension(years, [("US", "Leap Day", "0229"), ("VN", "National Day", "0902")], rules, tet).collect()
    by = lambda name: {r.date for r in out if r.name == name}
    assert by("Thanksgiving") == {date(1999, 11, 25), date(2000, 11, 23), date(2001, 11, 22), date(2024, 11, 28), date(2038, 11, 25)}
    assert len({d.isocalendar().week for d in by("Thanksgiving")}) > 1
    assert by("Memorial Day") == {date(1999, 5, 31), date(2000, 5, 29), date(2001, 5, 28), date(2024, 5, 27), date(2038, 5, 31)}
    assert by("Easter") == {date(1999, 4, 4), date(2000, 4, 23), date(2001, 4, 15), date(2024, 3, 31), date(2038, 4, 25)}
    assert by("Leap Day") == {date(2000, 2, 29), date(2024, 2, 29)} and len(by("National Day")) == 5
    assert by("Tet") == {date(2001, 1, 23) + datetime.timedelta(i) for i in range(4)}
    assert {r.movable for r in out if r.name in ("Tet", "Easter")} == {True}


def test_best_method_beside_the_rows_equals_the_table(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(n), float(a), float(a + rng.normal()), None if n % 5 == 0 else float(a * 1.1), float(a + rng.normal()))
            for k in "abcd" for n, a in enumerate(rng.integers(0 if k == "d" else 1, 1 if k == "d" else 9, 12))]
    frame = spark.createDataFrame([*rows, ("e", 0, 4.0, 4.0, 4.0, 4.0), ("f", 0, 1.0, 9.0, 9.0, None)],
                                  "k string, n int, y double, m1 double, m2 double, m3 double")
    methods = ["m1", "m2", "m3"]
    table = evaluation.best_method(evaluation.method_table(frame, ["k"], "y", methods), ["k"], methods)
    expected = {r.k: (r.method, r.fa) for r in table.collect()}
    out = evaluation.with_best_method(frame, ["k"], "y", methods).collect()
    assert len(out) == len(rows) + 2 and all((r.method, r.fa) == expected[r.k] for r in out)
    assert expected["e"] == ("m1", 1.0) and expected["d"][0] == "BLANK" and expected["f"][0] == "BLANK"


def test_forecast_chain_moves_the_series_once(spark, folder):
    t = Tables(spark, folder)
    source = str(t.plan._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")
    for name in ("ts14_apply_phasing", "ts15_best_method"):
        plan = str(entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan())
        assert plan.count("Exchange hashpartitioning") <= source + 1 and "lineitem" in plan
