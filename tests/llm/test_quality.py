import zlib

import numpy as np
import pytest

from aisle.llm import quality


def test_prior_and_risk_recover_classes_that_were_never_labelled_negative():
    draw = np.random.default_rng(4)
    good = lambda n: draw.normal(0, 1, (n, 6))
    bad = lambda n: draw.normal(2.2, 1, (n, 6))
    positive, unlabelled = good(2_000), np.concatenate([good(2_100), bad(900)])
    model, prior = quality.fit_prior_and_risk(positive, unlabelled)
    assert 0.6 < prior < 0.8
    assert (model.scores(good(1_000)) >= 0.5).mean() > 0.95
    assert (model.scores(bad(1_000)) < 0.5).mean() > 0.95


def test_held_out_labels(spark, folder):
    # The smallest tables have few labels, so the middle ones are used.
    base = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all(0 <= r.score <= 1 for r in rows)
    good, bad = [r.predicted for r in held if r.quality == 1], [r.predicted for r in held if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark, folder):
    base = folder.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(
        quality.in_fold(quality.F.col("doc_id"), 5), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    first, second = quality.learn(docs, labels), quality.learn(docs.select("doc_id", "text"), turned)
    x = quality.features([b"Some text here.", b"", b"AA!! BB!! CC!!"])
    assert np.array_equal(first.scores(x), second.scores(x))


def test_features_of_one_text_do_not_depend_on_its_neighbours():
    texts = [b"", b"one", b"a a a a", "É x\n\ny".encode(), b"  ", b"A!! B!! \n" * 500]
    together = quality.features(texts)
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-6) and np.isfinite(together).all()


def test_odd_rows_and_too_few_labels(odd, nothing):
    labels = odd.sparkSession.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    assert quality.learn(odd, labels) is None
    rows = quality.score(odd, None, keep=["row", "shard"]).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5} and rows[0].shard == "x"
    assert quality.learn(nothing, labels) is None
    assert quality.score(nothing, None).count() == 0
    draw = np.random.default_rng(0)
    model = quality.fit_risk(draw.normal(size=(50, quality.N_FEATURES)), draw.normal(size=(50, quality.N_FEATURES)), 0.5)
    assert all(np.isfinite(r.score) for r in quality.score(odd, model).collect())


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_estimated_prior(prior):
    draw = np.random.default_rng(7)
    p = draw.normal(3, 1, 4_000)
    u = np.concatenate([draw.normal(3, 1, int(6_000 * prior)), draw.normal(-1, 1, int(6_000 * (1 - prior)))])
    assert abs(quality.estimate_prior(p, u) - prior) < 0.05
