import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.llm import sketches as sk

SCALE = sk.Scale()


def plain_set(text, size=5):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split() if w]
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    return {int(hashlib.md5(r).hexdigest()[:15], 16) for r in runs}


def plain_sketch(known, scale=SCALE):
    order = sorted(known)
    limit = sk.TOP if len(order) <= scale.floor else max(int(scale.fraction * 2**60) - 1, order[scale.floor - 1])
    return limit, [h for h in order if h <= limit]


def plain_likeness(a, b):
    limit = min(a[0], b[0])
    x, y = ({h for h in s[1] if h <= limit} for s in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for at, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(at + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, following = (plain_sketch(plain_set(t)) for t in (text, edited, after))
        show = lambda s: f"{s[0]:015x}:" + "".join(f"{h:015x}" for h in s[1])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(changed),
                    plain_likeness(own, changed), plain_likeness(own, following), len(plain_set(text))))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [16 << 20, 2_000, 1])
def test_edits_equal_brute_force(odd, documents, part_bytes):
    for df in (odd, documents):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        out = sk.compare_edits(df, part_bytes=part_bytes)
        assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_few_rows(spark, nothing):
    assert sk.compare_edits(nothing).count() == 0 and sk.sketch_documents(nothing).count() == 0
    for rows in ([(1, "abcdefgh")], [(1, None)], [(None, "a b"), (None, "a b")], [(2, "same"), (2, "same"), (1, "same")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, sk.compare_edits(df, part_bytes=1).collect()), key=str) == brute(rows)


def test_columns_equal_the_plain_sketch(odd):
    rows = [(r.doc_id, r.sketch) for r in sk.sketch_documents(odd).collect()]
    plain = sorted((plain_sketch(plain_set(r.text or "")) for r in odd.collect()), key=str)
    assert sorted(((s.limit, s.hashes) for _, s in rows), key=str) == plain


def vocabulary(n, seed):
    draw = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in draw.integers(50_000, size=n))


def test_containment_between_very_unequal_documents(spark):
    """A part of 2,000 words in a document of 100,000 words: the part's containment is seen from both sizes."""
    part, other = vocabulary(2_000, 1), vocabulary(1_000, 2)
    rows = [(1, part + " " + other), (2, vocabulary(50_000, 3) + " " + part + " " + vocabulary(50_000, 4))]
    held = sk.sketch_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = (held.where(f"doc_id = {i}").select(F.col("sketch").alias(f"s{i}")) for i in (1, 2))
    both = a.join(b, F.lit(True)).select(
        sk.containment(F.col("s1"), F.col("s2")).alias("small"), sk.containment(F.col("s2"), F.col("s1")).alias("large"),
        sk.jaccard(F.col("s1"), F.col("s2")).alias("jaccard"), sk.jaccard(F.col("s1"), F.col("s1")).alias("self"))
    r = both.first()
    assert abs(r.small - 2 / 3) < 0.12 and r.large < 0.05 and abs(r.jaccard - 2 / 101) < 0.02 and r.self == 1
    empty = sk.sketch_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert empty.select(sk.jaccard(F.col("sketch"), F.col("sketch")).alias("j"),
                        sk.containment(F.col("sketch"), F.col("sketch")).alias("c")).first() == (1.0, None)


def test_estimates_come_close(documents):
    """Mean absolute error of the likeness against the exact sets, over all documents."""
    rows = sorted(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    exact = {}
    for at, r in enumerate(rows):
        after, cut = rows[(at + 1) % len(rows)].text, len(r.text) // 4
        x, y = plain_set(r.text), plain_set(r.text[: len(r.text) - cut] + after[:cut])
        exact[r.doc_id] = len(x & y) / len(x | y) if x | y else 1.0
    near = {r.doc_id: r.near_edited for r in sk.compare_edits(documents).collect()}
    error = [abs(near[i] - exact[i]) for i in exact]
    assert np.mean(error) < 0.08 and abs(np.mean([near[i] - exact[i] for i in exact])) < 0.03


def test_merged_sketches_equal_the_sketch_of_the_union(odd, documents):
    texts = [(i % 3, r.text) for i, r in enumerate(documents.collect())] + [(7, None), (7, " "), (8, "a b c"), (8, "d"), (9, "x " * 9)]
    spark = documents.sparkSession
    held = sk.sketch_documents(spark.createDataFrame(texts, "doc_id long, text string"))
    merged = sk.merge(held.withColumnRenamed("doc_id", "team"), "team").collect()
    for team in {t for t, _ in texts}:
        limit, hashes = plain_sketch(set().union(*(plain_set(x or "") for t, x in texts if t == team)))
        own = [r for r in merged if r.team == team]
        assert {r.limit for r in own} == {limit}
        assert sorted(r.hash for r in own if r.hash is not None) == hashes and (hashes or len(own) == 1)
