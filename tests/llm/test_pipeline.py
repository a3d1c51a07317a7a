"""Every stage against a plain version of itself on the same input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_jaccard import brute as classes
from test_lines import brute as kept_lines
from test_packing import check_sequences

from aisle.llm import quality


@pytest.fixture(scope="module")
def base(folder):
    # The smallest tables have too few labels.
    return folder.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def some(spark, base):
    return spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 400").cache()


def rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_quality_stage(spark, base):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    out = corpus_pipeline.keep_quality(spark, docs, base)
    assert out.columns == docs.columns
    model = quality.learn(docs, spark.read.parquet(f"{base}/labels.parquet"))
    expected = sorted((r.doc_id, r.text) for r in docs.collect()
                      if model.scores(quality.features([r.text.encode()]))[0] >= 0.3)
    assert rows(out) == expected
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    kept = {i for i, _ in expected}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.98 * len(good)


def test_line_stage(spark, base, some):
    out = corpus_pipeline.drop_lines(spark, some, base)
    assert out.columns == some.columns
    expected = kept_lines([(r.doc_id, r.text) for r in some.collect()], 40, 5)
    assert sorted((str(i), t) for i, t in rows(out)) == [(r[0], r[3]) for r in expected]
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_duplicate_stage(spark, base, some):
    out = corpus_pipeline.drop_near_duplicates(spark, some, base)
    pairs = [(r.doc_id, r.text) for r in some.collect()]
    stay = {i for i, _, c in classes(pairs, 5, 80) if i == c}
    assert rows(out) == sorted((i, t) for i, t in pairs if str(i) in stay)
    assert len(stay) < len(pairs)


def test_stages_take_odd_rows(spark, base, odd, nothing):
    full = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.col("shard").alias("source"),
                      F.length("text").cast("bigint").alias("n_chars"))
    for docs in (full, full.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, base)
            assert docs.columns == full.columns
        corpus_pipeline.pack(spark, docs, base).count()


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and check_sequences(out, 4096)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_copies_leave_one_document(spark, base, some, tmp_path, monkeypatch):
    """Eight documents of 40 lines that differ in one line each: no scraps of the others stay."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    columns = some.select(*corpus_pipeline._COLUMNS)
    body = [f"Row {i} tells of harbour {i * 7} and of the boats that came there in spring" for i in range(40)]
    texts = ["\n".join([*body[:d], f"Only paper {d} adds this remark about its own printer", *body[d + 1 :]]) for d in range(8)]
    extra = spark.createDataFrame([(900_000 + d, t, "en", "x", len(t)) for d, t in enumerate(texts)], columns.schema)
    columns.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert {i for i in out if i >= 900_000} == {900_007}


def test_copies_and_wordless_texts_leave_one_document(spark, base, some, tmp_path, monkeypatch):
    # The classifier treats equal texts alike; without it, none of the planted ones is rejected.
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    docs = some
    alone = sorted((r for r in docs.collect() if len(r.text) > 400), key=lambda r: r.doc_id)[:3]
    planted, groups = [], {}
    for number, (row, copies) in enumerate(zip(alone, (2, 5, 50), strict=True)):
        # Own words in long lines, below a title too short for the line rule.
        words = [f"{w}{number}q" if n % 9 == 0 else w for n, w in enumerate(row.text.split())]
        body = [" ".join(words[i : i + 20]) for i in range(0, len(words), 20)]
        text = "\n".join([" ".join(words[:2]), *body])
        ids = range(100_000 * (number + 1), 100_000 * (number + 1) + copies)
        groups[number] = set(ids)
        planted += [(i, text.encode().upper().decode() if i % 10 == 9 else text, row.lang, row.source, len(text)) for i in ids]
    extra = spark.createDataFrame(planted, docs.select(*corpus_pipeline._COLUMNS).schema)
    docs.select(*corpus_pipeline._COLUMNS).unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert [len(out & ids) for ids in groups.values()] == [1, 1, 1]

    full = docs.select(*corpus_pipeline._COLUMNS)
    blank = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in ((-3, ""), (-2, None), (-1, " \n"), (None, ""))], full.schema)
    left = corpus_pipeline.drop_near_duplicates(spark, full.where("doc_id < 20").unionByName(blank), base)
    assert [r.doc_id for r in left.where("doc_id < 0 OR doc_id IS NULL").orderBy("doc_id").collect()] == [None, -3]
    shared = "A line of the same forty code points or more in all of these."
    six = spark.createDataFrame([(i, shared, "en", "x", 61) for i in range(5)] + [(9, f"{shared}\nOwn words", "en", "x", 71)], full.schema)
    assert [r.doc_id for r in corpus_pipeline.drop_lines(spark, six, base).collect()] == [9]
