from collections import defaultdict

import numpy as np

from aisle.llm import components, vectors


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components_of_random_links_and_a_long_path(spark):
    draw = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1120)]
    pairs += [(5000, i) for i in range(5001, 5200)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    out = {r.node: r.component for r in components.components(frame).collect()}
    real = [(a, b) for a, b in pairs if a != b]
    assert out == roots({n for p in real for n in p}, real)
    assert components.components(frame.limit(0)).count() == 0


def brute(rows, least):
    ok = [(i, y, np.array(v, float)) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = defaultdict(int), []
    for n, (i, y, a) in enumerate(ok):
        for j, z, b in ok[n + 1 :]:
            if y == z and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    root = roots({i for i, _, _ in rows if i is not None}, pairs)
    return sorted((str(i), links[i], str(root.get(i))) for i, _, _ in rows)


def cloud(draw, n, d=16):
    centres = draw.normal(size=(n // 6, d))
    near = centres[draw.integers(0, len(centres), n)] + draw.normal(size=(n, d)) * draw.choice([0.02, 0.08, 0.6], (n, 1))
    return [(i, int(draw.integers(0, 2)), [float(x) for x in v]) for i, v in enumerate(near)]


def test_links_and_components_against_all_pairs(spark):
    rows = cloud(np.random.default_rng(1), 700)
    # A ball of near copies that no split parts, and exact copies in two labels.
    centre = np.random.default_rng(2).normal(size=16)
    rows += [(1000 + i, 0, [float(x) for x in centre + np.random.default_rng(i).normal(size=16) * 0.03])
             for i in range(150)]
    rows += [(2000 + i, i % 2, rows[3][2]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    out = vectors.near_duplicates(frame, 0.98, leaf_rows=40, block=50).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, 0, v), (2, 0, [2.0, 4.0, 6.0]), (3, None, v), (4, 0, None), (5, 0, []), (6, 0, [0.0, 0.0, 0.0]),
            (7, 0, [1.0, None, 3.0]), (8, 0, [1.0, float("nan"), 3.0]), (9, 0, [float("inf"), 2.0, 3.0]),
            (10, 1, v), (11, 0, [1.0, 2.0]), (12, 0, [2.0, 4.0]), (13, 0, v)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    out = vectors.near_duplicates(frame).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(rows, 0.98)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0
    clash = frame.selectExpr("vec_id", "label", "embedding", "1 AS row", "'x' AS component_id", "2 AS v")
    assert vectors.near_duplicates(clash).count() == len(rows)


def test_forest_finds_nearly_all_pairs_at_the_threshold():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.981 * x + np.sqrt(1 - 0.981**2) * side
    forest = vectors.Forest.fit(np.concatenate([x, y]), 4, 8, float(np.sqrt(0.04) / 8))
    held = [defaultdict(set), defaultdict(set)]
    for side_of, z in zip(held, (x, y), strict=True):
        for row, leaf in zip(*forest.leaves(z), strict=True):
            side_of[row].add(leaf)
    assert all(held[0][i] & held[1][i] for i in range(len(x)))
    one = sum(bool({q for q in held[0][i] if q < 256} & held[1][i]) for i in range(len(x)))
    assert one > 0.97 * len(x)


def planted(draw, n, d, closest, furthest):
    """Unit vectors, each with a partner at a cosine between the two."""
    x = draw.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = draw.uniform(furthest, closest, (n, 1))
    return x, c * x + np.sqrt(1 - c**2) * side


def test_links_near_the_threshold_in_leaves_below_leaves(spark):
    draw = np.random.default_rng(8)
    x, y = planted(draw, 2_500, 64, 0.99, 0.972)
    ball = draw.normal(size=64) + draw.normal(size=(300, 64)) * 0.02
    rows = np.concatenate([x, y, ball / np.linalg.norm(ball, axis=1, keepdims=True)])
    close = np.triu(rows @ rows.T >= 0.98, 1)
    pairs = list(zip(*np.nonzero(close), strict=True))
    expected = roots(range(len(rows)), pairs)
    links = close.sum(0) + close.sum(1)
    frame = spark.createDataFrame(
        [(i, "one label", v.tolist()) for i, v in enumerate(rows)], "vec_id long, label string, embedding array<double>")
    placed = vectors._deepened(vectors.checkpointed(spark.createDataFrame(
        [(i, "one label", 1, v.tobytes(), [0]) for i, v in enumerate(rows)], vectors._PLACED)), 64, 0.025, 40)
    sizes = [r["count"] for r in placed.selectExpr("explode(leaves) AS leaf").groupBy("leaf").count().collect()]
    assert len(sizes) > 64 and sorted(sizes)[-2] < 600
    # Trees fitted on 200 vectors are five levels deep at most; the leaves below them do the rest.
    out = {r.vec_id: r for r in vectors.near_duplicates(frame, 0.98, leaf_rows=40, sample=200, block=100).collect()}
    assert len(out) == len(rows)
    found = sum(out[i].n_links for i in out)
    assert found <= links.sum() and found >= 0.99 * links.sum()
    assert all(out[i].n_links <= links[i] for i in out)
    assert sum(out[i].component_id == expected[i] for i in out) >= 0.99 * len(rows)
