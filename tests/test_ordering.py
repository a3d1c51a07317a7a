"""Distributed ranks and percentiles against plain Python, with a hot key and many ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.operators import ordering, quality, windows

ROWS = 3000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # A third of the rows share one key, and a third of the values are equal.
    return [
        (i, "hot" if i % 3 == 0 else f"k{i % 17}", 5.0 if rng.random() < 0.33 else float(rng.randrange(400)))
        for i in range(ROWS)
    ]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key string, value double")


def by_key(rows):
    groups = {}
    for _, key, value in rows:
        groups.setdefault(key, []).append(value)
    return groups


def test_exact_percentiles(frame, rows):
    out = ordering.exact_percentiles(frame, ["key"], "value", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()
    expected = by_key(rows)
    assert len(out) == len(expected)
    for r in out:
        np.testing.assert_allclose(
            [r.p10, r.p50, r.p99], np.percentile(expected[r["key"]], [10, 50, 99]), rtol=1e-12)


def test_percent_ranks(frame, rows):
    expected = by_key(rows)
    for r in ordering.percent_ranks(frame, ["key"], "value", "rank").collect():
        values = expected[r["key"]]
        above = sum(v > r["value"] for v in values)
        assert r["rank"] == pytest.approx(above / (len(values) - 1))


def test_running_totals(frame, rows):
    out = {r.id: r for r in ordering.running_totals(
        frame, [F.col("value").desc(), F.col("id")], {"upto": "value"}).collect()}
    total = 0.0
    for n, (i, _, value) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        total += value
        assert out[i].row_no == n and out[i].upto == pytest.approx(total)


def test_abc_classes(frame, rows):
    totals = frame.groupBy("key").agg(F.sum("value").alias("v"))
    out = {r["key"]: r.abc_class for r in ordering.abc_classes(totals, "key", "v").collect()}
    sums = sorted(((sum(v), k) for k, v in by_key(rows).items()), key=lambda p: (-p[0], p[1]))
    whole, run = sum(s for s, _ in sums), 0.0
    for s, k in sums:
        run += s
        assert out[k] == ("A" if run / whole <= 0.8 else "B" if run / whole <= 0.95 else "C")


def test_equal_frequency_bins(frame):
    out = ordering.equal_frequency_bins(frame, [F.col("value"), F.col("id")], 7).groupBy("bin").count().collect()
    assert sorted(r["count"] for r in out) == sorted([ROWS // 7 + (i < ROWS % 7) for i in range(7)])


def test_cap_per_label_is_repeatable(frame):
    first = {r.id for r in windows.cap_per_label(frame, ["key"], 20, ["id"]).collect()}
    again = {r.id for r in windows.cap_per_label(frame.repartition(7), ["key"], 20, ["id"]).collect()}
    assert first == again and len(first) == 18 * 20


def test_null_keys_and_values_keep_their_rows(spark):
    frame = spark.createDataFrame(
        [(1, None, 3.0), (2, None, 1.0), (3, None, None), (4, "a", None), (5, "b", 2.0)], "id bigint, key string, value double")
    middle = {r.key: r.mid for r in ordering.exact_percentiles(frame, ["key"], "value", {"mid": 0.5}).collect()}
    assert middle == {None: 2.0, "a": None, "b": 2.0}
    ranks = {r.id: r.percent_rank for r in ordering.percent_ranks(frame, ["key"], "value").collect()}
    assert ranks == {1: 0.0, 2: 0.5, 3: 1.0, 4: 0.0, 5: 0.0}
    runs = ordering.running_totals(frame, [F.col("id")], {"total": "value"}, ["key"])
    assert {r.id: (r.row_no, r.total) for r in runs.collect()} == {
        1: (1, 3.0), 2: (2, 4.0), 3: (3, 4.0), 4: (1, 0.0), 5: (1, 2.0)}


def test_summary_lists_a_column_without_values(spark):
    frame = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    out = {r.column: r for r in quality.summary(frame, ["x", "y"], {"mid": 0.5}).collect()}
    assert (out["x"]["count"], out["x"].mid) == (2, 2.0)
    assert (out["y"]["count"], out["y"].mid) == (0, None)
