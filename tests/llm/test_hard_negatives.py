import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.llm import hard_negatives as hn
from aisle.llm.cover_tree import Best, Block, CoverTree, augmented, bounds, products, search


def clustered(seed, n=900, dims=12, clusters=25, scale=60):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(clusters, dims)) * scale
    return np.floor(middle[draw.integers(clusters, size=n)] + draw.normal(size=(n, dims)) * 4).astype(np.int64)


def brute(rows, is_anchor, positives=5, negatives=5, percent=(80, 100)):
    """rows: {id: (label, vector)}"""
    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = []
    for anchor, (label, v) in rows.items():
        if not is_anchor(anchor):
            continue
        scored = sorted(((-score(v, w), i, other) for i, (other, w) in rows.items() if i != anchor))
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and percent[0] * -p <= 100 * -s[0] <= percent[1] * -p]
            out += [(anchor, i, rank, j, -p, -n) for rank, (n, j, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(rows, **how):
    return sorted(map(tuple, hn.hard_negatives(rows, F.col("vec_id") % 10 == 0, **how).collect()))


def test_tree_covers_all_rows_and_bounds_hold():
    for v in (clustered(1), clustered(2, scale=0), np.repeat(clustered(3, n=7), 40, axis=0), clustered(4, n=1)):
        most = float(np.linalg.norm(v, axis=1).max())
        x = augmented(v.astype(float), most)
        assert np.allclose(np.linalg.norm(x, axis=1), most)
        tree = CoverTree.build(x, leaf=16)
        assert sorted(tree.order) == list(range(len(v)))
        x, v = x[tree.order], v[tree.order]

        def below(node):
            rows = list(range(tree.low[node], tree.low[node] + tree.own[node]))
            for c in range(tree.child[node], tree.child_end[node]):
                assert tree.radius[c] <= tree.radius[node] / 2 + 1e-9
                rows += below(c)
            away = np.linalg.norm(x[rows] - x[tree.centre[node]], axis=1)
            assert away.max() <= tree.radius[node] + 1e-9
            return rows

        assert sorted(below(0)) == list(range(len(v)))
        q = clustered(9, n=20).astype(float)
        for node in range(len(tree.radius)):
            low, up = bounds(q @ v[tree.centre[[node]]].T, np.linalg.norm(q, axis=1), tree.radius[[node]], most)
            score = q @ v[below(node)].T
            assert (score >= low).all() and (score <= up).all()


def test_descent_skips_nodes_and_finds_the_same(monkeypatch):
    v = clustered(5, n=3_000, clusters=60)
    most = float(np.linalg.norm(v, axis=1).max())
    tree = CoverTree.build(augmented(v.astype(float), most), leaf=32)
    block = Block(1, np.arange(3_000)[tree.order], v[tree.order], tree)
    seen = []
    monkeypatch.setattr("aisle.llm.cover_tree.products", lambda a, b: seen.append(a.shape[0] * b.shape[0]) or products(a, b))
    queries, score = v[:10], v[:10] @ v.T
    high = np.sort(score, axis=1)[:, -40]
    best = Best(high, high, (80, 100), 5)
    search([block], queries, [np.ones(10, bool)], np.arange(10), best, np.arange(10), most)
    assert sum(seen) < 0.5 * score.size
    for w in range(10):
        fit = [(-s, i) for i, s in enumerate(score[w]) if i != w and 80 * high[w] <= 100 * s <= 100 * high[w]]
        assert [(-s, i) for s, i in zip(best.score[best.window == w], best.id[best.window == w], strict=True)] == sorted(fit)[:5]


@pytest.mark.parametrize("how", [{}, {"block_rows": 50, "group_rows": 7, "sample": 100}, {"positives": 2, "negatives": 9}])
def test_equals_brute_force_with_ties_and_clusters(spark, how):
    v = np.concatenate([clustered(6, n=400, scale=12), np.repeat(clustered(7, n=5), 20, axis=0)])
    labels = np.random.default_rng(8).integers(4, size=len(v)) ** 2 // 3
    rows = {int(i): (int(k), w.tolist()) for i, (k, w) in enumerate(zip(labels, v, strict=True))}
    df = spark.createDataFrame([(i, k, w, "x", 1) for i, (k, w) in rows.items()],
                               "vec_id long, label long, v array<bigint>, cell string, id int").repartition(3)
    some = {k: w for k, w in how.items() if k in ("positives", "negatives")}
    expected = brute(rows, lambda i: i % 10 == 0, **some)
    assert len(expected) > 100 and mined(df, **how) == expected


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.9, 0.5]), (3, None, [1.0, 1.0]), (4, 1, None), (None, 2, [1.0, 1.0]),
            (5, 2, [1.0, None]), (6, 2, [math.nan, 1.0]), (7, 2, [math.inf, 1.0]), (8, 2, []), (9, 2, [1.0, 0.4, 0.0]), (10, 3, [2.0]),
            (2, 2, [0.9, 0.5]), (20, 1, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, row string")
    whole = hn.quantised(df)
    assert {r.vec_id for r in whole.collect()} == {0, 1, 2, 8, 9, 10, 20}
    once = {r.vec_id: (r.label, r.v) for r in whole.collect()}
    assert mined(whole) == brute(once, lambda i: i % 10 == 0) and mined(whole)
    assert mined(whole.where("vec_id IS NULL")) == [] and mined(whole.where("vec_id = 1")) == []
    assert mined(whole.where("vec_id IN (0, 1)")) == []


def test_scores_beyond_doubles_are_exact():
    a = np.array([[2**26 + 1, 3]])
    b = np.array([[2**26 + 1, 5], [2**26 - 1, 7]])
    assert products(a, b).tolist() == [[(2**26 + 1) ** 2 + 15, (2**26 + 1) * (2**26 - 1) + 21]]
    with pytest.raises(OverflowError):
        products(a * 2**10, b)
