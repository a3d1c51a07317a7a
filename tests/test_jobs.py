"""Storage, incremental batches and learning jobs."""

import tempfile
from datetime import date
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from aisle.operators import learning
from aisle.plans import learning as learning_plans, windows as window_plans
from aisle.sources import readers, retail, writers
from aisle.streaming import incremental


def test_append_new_keeps_stored_rows(spark):
    path = tempfile.mkdtemp(prefix="aisle-test-") + "/table"
    incremental.append_new(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), path, ["k"], ["v"])
    incremental.append_new(spark.createDataFrame([(1, "z"), (2, "c")], "k int, v string"), path, ["k"], ["v"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]
    assert incremental.changed_files(spark, path, "2000-01-01 00:00:00").count() >= 2
    assert incremental.changed_files(spark, path, "2999-01-01 00:00:00").count() == 0


def test_damaged_files_cost_themselves_alone(spark, tmp_path):
    """A file with a good footer and a bad body, one without a footer, one missing, an empty one, other columns."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name, rows in (("a", 5_000), ("b", 4_000), ("bad", 6_000), ("none", 0)):
        table = pa.table({"id": pa.array(range(rows), pa.int64()), "text": pa.array([f"{name} {i}" for i in range(rows)], pa.string())})
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=1_000, use_dictionary=False)
    pq.write_table(pa.table({"id": [7], "more": [1.5]}), tmp_path / "c.parquet")
    broken = bytearray((tmp_path / "bad.parquet").read_bytes())
    middle = len(broken) // 2
    broken[middle : middle + 4_000] = b"\xff" * 4_000
    (tmp_path / "bad.parquet").write_bytes(broken)
    (tmp_path / "text.parquet").write_text("not a table")
    rows, report = readers.read_files(spark, str(tmp_path), str(tmp_path / "nowhere"))
    out = {r.path.rsplit("/", 1)[-1]: (r.rows, r.status) for r in report.collect()}
    assert out == {
        "a.parquet": (5_000, "read"), "b.parquet": (4_000, "read"), "c.parquet": (1, "read"), "bad.parquet": (6_000, "damaged"),
        "text.parquet": (None, "nothing read"), "none.parquet": (None, "nothing read"), "nowhere": (None, "missing")}
    assert rows.count() == 9_001 and set(rows.columns) == {"id", "text", "more"}
    assert rows.where("text LIKE 'bad%'").count() == 0 and rows.agg({"more": "sum"}).first()[0] == 1.5


def test_read_many_isolates_failures(spark):
    base = tempfile.mkdtemp(prefix="aisle-test-")
    spark.range(2).write.parquet(f"{base}/a")
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{base}/b")
    merged, failed = readers.read_many([f"{base}/a", f"{base}/none", f"{base}/b"], spark.read.parquet)
    assert merged.count() == 5 and list(failed) == [f"{base}/none"]


def test_clean_columns(spark):
    frame = spark.createDataFrame([(1, 2, 3)], ["A  b", "a_B", "%TTS (x)"])
    assert readers.clean_columns(frame).columns == ["a_b", "a_b_2", "tts_x"]


def test_dynamic_overwrite_touches_only_its_partitions(spark):
    path = tempfile.mkdtemp(prefix="aisle-test-") + "/table"
    writers.write_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    writers.write_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_nearest_neighbours_in_blocks_match_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(120, 5))
    frame = spark.createDataFrame(
        [(i, [float(x) for x in p], int(i % 3)) for i, p in enumerate(points)], "id bigint, v array<double>, label int")
    train, queries = frame.where("id >= 20").repartition(5), frame.where("id < 20")
    # Blocks of a few rows, so that every query meets many.
    out = learning.nearest_neighbours(train, queries, "id", "v", "label", 4, block_rows=7).collect()
    assert len(out) == 80
    for r in out:
        distance = np.linalg.norm(points[20:] - points[r["query"]], axis=1)
        assert r.neighbour == 20 + int(np.argsort(distance, kind="stable")[r["rank"] - 1])
        assert abs(r.distance - np.sort(distance)[r["rank"] - 1]) < 1e-9


def test_nearest_neighbours_of_many_vectors(spark):
    """20,000 vectors with the default blocks, many of them equal; nulls take no part; no row comes to the driver."""
    rng = np.random.default_rng(5)
    points = np.round(10 * rng.normal(size=(20_000, 6)))  # whole numbers, so that equal distances are equal in doubles
    points[5_000:9_000] = points[17]
    rows = [(i, p.tolist(), i % 4) for i, p in enumerate(points)]
    frame = spark.createDataFrame([*rows, (None, [0.0] * 6, 1), (30_000, None, 1), (30_001, [0.0] * 5 + [None], 1)],
                                  "id bigint, v array<double>, label int").repartition(6)
    out = learning.nearest_neighbours(frame.where("id % 40 <> 0 OR id IS NULL"), frame.where("id % 40 = 0"), "id", "v", "label", 5)
    held = out.collect()
    known = np.array([i for i in range(20_000) if i % 40])
    assert len(held) == 500 * 5
    for r in held[::7]:
        distance = np.linalg.norm(points[known] - points[r["query"]], axis=1)
        best = np.lexsort((known, distance))[r["rank"] - 1]
        assert (r.neighbour, r.label) == (known[best], known[best] % 4) and abs(r.distance - distance[best]) < 1e-9
    nobody = frame.where("id < 0")
    assert learning.nearest_neighbours(nobody, frame.where("id < 5"), "id", "v", "label", 5).count() == 0
    assert learning.nearest_neighbours(frame.where("id < 5"), nobody, "id", "v", "label", 5).count() == 0


def test_leave_one_out(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0)], "k string, y double")
    out = sorted((r.k, r.y, r.e) for r in learning.leave_one_out(frame, "k", "y", "e").collect())
    assert out == [("a", 1.0, 3.0), ("a", 3.0, 1.0), ("b", 8.0, 4.0)]


def test_hash_split_is_stable(spark):
    frame = spark.range(1000)
    first = {r.id for r in learning.random_split(frame, "id").where("part = 'train'").collect()}
    again = {r.id for r in learning.random_split(frame.repartition(9), "id").where("part = 'train'").collect()}
    assert first == again and 740 < len(first) < 860


def test_balanced_weights(spark):
    frame = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    out = {r.label: r.weight for r in learning.balanced_weights(frame, "label").collect()}
    assert out == {0: 4 / 6, 1: 2.0}


def test_random_settings_and_comparison(spark):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    line, tree = LogisticRegression(maxIter=5), DecisionTreeClassifier(seed=1)
    space = {line.regParam: (1e-3, 1.0, "log"), line.elasticNetParam: (0.0, 0.5)}
    drawn = learning.random_settings(space, 40)
    assert drawn == learning.random_settings(space, 40) != learning.random_settings(space, 40, seed=8)
    assert all(1e-3 <= s[line.regParam] <= 1 and 0 <= s[line.elasticNetParam] <= 0.5 for s in drawn)
    assert sum(s[line.regParam] < 0.03 for s in drawn) > 8  # even in the logarithm
    assert {s[tree.maxDepth] for s in learning.random_settings({tree.maxDepth: (1, 3)}, 40)} == {1, 2, 3}
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 2))
    rows = [(i, float(x), float(y), float(x + 0.3 * y + e > 0)) for i, ((x, y), e) in enumerate(zip(points, 0.3 * rng.normal(size=300)))]
    frame = learning.assemble(spark.createDataFrame(rows, "id long, x double, y double, label double"), ["x", "y"], "id", "label")
    out = learning.random_search([("line", line, space), ("tree", tree, {tree.maxDepth: [2, 3]})], 2,
                                 BinaryClassificationEvaluator(), frame, "id").collect()
    assert [r["rank"] for r in out] == [1, 2, 3, 4] and {r.estimator for r in out} == {"line", "tree"}
    scores = [r.score for r in out]
    assert scores == sorted(scores, reverse=True) and scores[-1] > 0.75 and all(r.deviation >= 0 for r in out)


def test_truncated_svd_equals_numpy(spark):
    rows = np.random.default_rng(4).normal(size=(200, 7)) * np.arange(1, 8)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(900, None)], "id long, v array<double>").repartition(4)
    values, right = learning.truncated_svd(frame, "v", 3)
    _, expected, turned = np.linalg.svd(rows)
    assert np.allclose(values, expected[:3]) and np.allclose(np.abs(right.T), np.abs(turned[:3]), atol=1e-6)


def test_models_beat_the_larger_class_on_rows_they_have_not_seen(spark):
    from aisle.plans import learning as plans
    from aisle.sources.retail import Tables

    tables = Tables(spark, "/root/testdata/sf0.01")
    for query in (plans.logistic_regression, plans.linear_svm):
        cells = {(r.label, r.prediction): r.rows for r in query(tables).collect()}
        whole = sum(cells.values())
        assert 0.1 * tables.labels.count() < whole < 0.3 * tables.labels.count()
        larger = max(sum(n for (label, _), n in cells.items() if label == k) for k in (0, 1))
        assert sum(n for (label, p), n in cells.items() if label == p) >= larger


def test_propensity_is_scored_on_outlets_held_out(spark):
    from aisle.plans import learning as plans
    from aisle.sources.retail import Tables

    tables = Tables(spark, "/root/testdata/sf0.01")
    out = plans.propensity(tables)
    rows = out.collect()
    outlets = learning.random_split(tables.outlets, "outlet")
    held = {r.outlet for r in outlets.where("part = 'test'").collect()}
    assert rows and {r.outlet for r in rows} <= held and len({(r.outlet, r.category) for r in rows}) == len(rows)
    assert len({r.category for r in rows}) == tables.products.select("category").distinct().count()
    for i in range(1, 5):
        proba = [(r[f"pred_proba_w{i}"], r[f"buy_next_{i}w"], r[f"pred_w{i}"]) for r in rows]
        assert all(0 <= p <= 1 and (p > 0.5) == (y == 1) for p, _, y in proba if abs(p - 0.5) > 1e-3)
        right = sum(label == y for _, label, y in proba)
        assert right >= 0.98 * max(sum(label == k for _, label, _ in proba) for k in (0, 1))


def larger_class(cells):
    """Rows told right, and rows of the larger class."""
    by_label = {}
    for r in cells:
        by_label[r.label] = by_label.get(r.label, 0) + r.rows
    return sum(r.rows for r in cells if r.label == r.prediction), max(by_label.values())


def test_trees_and_boosting_on_rows_they_have_not_seen(spark):
    from aisle.plans import learning as plans
    from aisle.sources.retail import Tables

    tables = Tables(spark, "/root/testdata/sf0.01")
    cells = plans.held_out_scores(tables).collect()
    for model in ("tree", "forest", "boosting"):
        right, larger = larger_class([r for r in cells if r.model == model])
        assert right >= larger
    # The given lines have a value that follows from none of their columns: no model may seem to explain it.
    errors = plans.held_out_errors(tables).collect()
    lines = tables.lineitem.count()
    assert [r.model for r in errors] == ["forest", "boosting"]
    assert all(0.17 * lines < r.rows < 0.23 * lines and abs(r.r2) < 0.02 and r.mae > 0 for r in errors)
    planted = tables.lineitem.withColumn("l_extendedprice", F.col("l_quantity") * 100 * (1 - F.col("l_discount")))
    errors = plans.held_out_errors(SimpleNamespace(lineitem=planted)).collect()
    assert len(errors) == 2 and all(r.r2 > 0.8 for r in errors)


def test_importances_are_shares_and_repeatable(spark):
    from aisle.plans import learning as plans
    from aisle.sources.retail import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    for query in (plans.trees, plans.boosting):
        first, again = ({(r.model, r.feature): r.importance for r in query(tables).collect()} for _ in range(2))
        assert set(first) == set(again) and all(abs(first[k] - again[k]) < 1e-9 for k in first)
        assert all(v >= 0 for v in first.values())
        for model in {m for m, _ in first}:
            assert abs(sum(v for (m, _), v in first.items() if m == model) - 1) < 1e-9


def test_elastic_net_equals_coordinate_descent(spark):
    """Least squares over scaled columns, the penalty relative to the deviation of the label."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, 1.0]
    y = x @ [2.0, -0.3, 0.5] + 4 + rng.normal(size=400)
    frame = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], "a double, b double, c double, y double")
    scale, deviation = x.std(axis=0, ddof=1), y.std(ddof=1)
    u, v = (x - x.mean(axis=0)) / scale, (y - y.mean()) / deviation
    for mixing in (0.0, 0.5, 1.0):
        penalty = 0.3 / deviation
        w = np.zeros(3)
        for _ in range(2000):
            for j in range(3):
                rest = v - u @ w + u[:, j] * w[j]
                rho = (u[:, j] * rest).mean()
                w[j] = np.sign(rho) * max(abs(rho) - penalty * mixing, 0) / ((u[:, j] ** 2).mean() + penalty * (1 - mixing))
        expected = w * deviation / scale
        got = {r.term: r.coefficient for r in learning.linear_coefficients(frame, "y", ["a", "b", "c"], 0.3, mixing).collect()}
        assert np.allclose([got[c] for c in "abc"], expected, atol=1e-3)
        assert abs(got["intercept"] - (y.mean() - x.mean(axis=0) @ expected)) < 1e-2


def test_clusters_hold_every_site_once(spark):
    from aisle.plans import learning as plans
    from aisle.sources.retail import Tables

    tables = Tables(spark, "/root/testdata/sf0.01")
    profiles = plans._profiles(tables)
    first, again = (sorted(map(tuple, plans.site_clusters(tables).collect())) for _ in range(2))
    assert first == again and len(first) == profiles.count() == len({r[0] for r in first})
    assert {r[1] for r in first} == {0, 1} and -1 <= first[0][2] <= 1
    spectral = plans.spectral_clusters(tables).collect()
    shipped = {r.site for r in tables.primary_lines.select("site").distinct().collect()}
    assert {r.site for r in spectral} == shipped and len(spectral) == len(shipped) and {r.cluster for r in spectral} <= {0, 1}


def test_clusters_part_two_clouds_and_report_their_silhouette(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(0, 1, (30, 2)), rng.normal(9, 1, (40, 2))])
    frame = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "site long, a double, b double")
    labels, score = learning.cluster(frame, "site", ["a", "b"], 2)
    found = {r.site: r.prediction for r in labels.collect()}
    assert len({found[i] for i in range(30)}) == len({found[i] for i in range(30, 70)}) == 1 and found[0] != found[69]
    scaled = (points - points.min(axis=0)) / (points.max(axis=0) - points.min(axis=0))
    square = ((scaled[:, None] - scaled[None]) ** 2).sum(axis=2)
    own = np.array([found[i] for i in range(70)])
    widths = []
    for i in range(70):
        a = square[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = square[i, own != own[i]].mean()
        widths.append((b - a) / max(a, b))
    assert abs(score - np.mean(widths)) < 1e-6


def test_text_models_beat_the_larger_class_on_rows_they_have_not_seen(spark):
    from aisle.plans import learning as plans
    from aisle.sources.retail import Tables

    tables = Tables(spark, "/root/testdata/sf0.01")
    rows = plans.text_filter(tables).collect()
    right = sum(r.label == r.prediction for r in rows)
    assert right >= max(sum(r.label == k for r in rows) for k in (0, 1))
    truth = {r.doc_id: r.lang for r in tables.documents.select("doc_id", "lang").collect()}
    titles = [r.asDict() for r in plans.title_classifier(tables).collect()]
    assert len(titles) > 0.15 * len(truth)
    best = [max(("de", "en", "es", "fr"), key=lambda c: r[f"{c}_proba"]) for r in titles]
    langs = [truth[r["doc_id"]] for r in titles]
    assert sum(a == b for a, b in zip(best, langs)) > max(langs.count(x) for x in set(langs))
    assert all(abs(sum(r[f"{c}_proba"] for c in ("de", "en", "es", "fr")) - 1) < 1e-3 for r in titles)


def test_lines_come_in_parts_of_bounded_size(spark, folder, monkeypatch):
    rows = {}
    for count in (None, 4_000_000):  # as if the files held that many lines
        t = retail.Tables(spark, folder)
        if count:
            t.__dict__["line_count"] = count
        seen = []
        for module, name in ((window_plans.ops, "diversity"), (learning_plans.ops, "fitted"), (learning_plans.kpi, "rfm_features")):
            real = getattr(module, name)
            frame = 1 if name == "fitted" else 0
            monkeypatch.setattr(module, name, lambda *a, real=real, frame=frame, **k: (
                seen.append(a[frame].rdd.getNumPartitions()), real(*a, **k))[1])
        first = window_plans.diversity(t)
        boosted = learning_plans.boosting(t)
        learning_plans.kpi.rfm_features(t.dealt(t.sales, "outlet"), ["outlet"], "date", date(2000, 3, 31))
        monkeypatch.undo()
        if count:
            assert (seen[0], *seen[2:]) == (8, 8, 8)
            assert t.product_weekly.rdd.getNumPartitions() == 8 and t.sales.rdd.getNumPartitions() == 8
        else:
            assert seen[2] == t.lineitem.rdd.getNumPartitions()
        rows[count] = [sorted(map(str, f.collect())) for f in (
            first, t.product_weekly, t.sales, boosted.select("feature", F.round("importance", 6)))]
    assert rows[None] == rows[4_000_000]


def test_clusters_compute_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    points = [(i, float(i % 7) + 100 * (i % 2), float(i % 5)) for i in range(40)]
    rows = spark.createDataFrame(points, "site long, x double, y double").mapInArrow(counted, "site long, x double, y double")
    labels, score = learning_plans.ops.cluster(rows, "site", ["x", "y"], 2)
    found = {r.site: r.prediction for r in labels.collect()}
    assert read.value == 40 and score > 0.7
    assert len({found[i] for i in range(0, 40, 2)}) == 1 and found[0] != found[1] and len(found) == 40
