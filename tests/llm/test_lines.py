import random
from collections import defaultdict

import numpy as np

from aisle.llm import lines


def brute(rows, least, documents):
    holders = defaultdict(set)
    for doc, text in rows:
        for key in lines.keys_of(text, least):
            if key:
                holders[key].add(doc)
    rank = lambda d: (d is not None, d)
    keeper = {k: max(d, key=rank) for k, d in holders.items() if len(d) >= documents}
    out = []
    for doc, text in rows:
        parts = (text or "").encode().split(b"\n")
        keys = lines.keys_of(text, least)
        stay = [x for x, k in zip(parts, keys, strict=True) if k not in keeper or keeper[k] == doc]
        out.append((str(doc), len(parts), len(parts) - len(stay), b"\n".join(stay).decode()))
    return sorted(out)


def found(frame):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text or "") for r in frame.collect())


def test_against_brute_force_with_full_filters(spark):
    draw = random.Random(2)
    pool = ["  Shared É line number %d \t" % i for i in range(30)] + ["short", "", " \r", "É" * 20]
    rows = [(i // 2 if i % 9 else None, "\n".join(draw.choice(pool) for _ in range(draw.randrange(8))) or None)
            for i in range(120)]
    rows += [(i, draw.choice(pool).upper().replace("É", "é")) for i in range(500, 540)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for documents in (2, 5):
        assert found(lines.dedup_lines(frame, least=20, documents=documents)) == brute(rows, 20, documents)


def test_a_saturated_filter_changes_nothing(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    monkeypatch.setattr(lines, "filter_bits", lambda n, most: 1 << 10)
    out = found(lines.dedup_lines(documents))
    assert out == brute(rows, 40, 5) and any(r[2] for r in out)


def test_odd_rows_and_kept_columns(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = lines.dedup_lines(odd, least=1, documents=2, keep=["row", "n_lines", "shard"])
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "row", "n_lines", "shard"]
    assert found(lines.dedup_lines(odd, least=1, documents=2)) == brute(rows, 1, 2)
    assert lines.dedup_lines(nothing).count() == 0


def test_scraps_of_near_copies_go(spark):
    """Eight near copies of forty lines leave one; a text whose lines are kept by a row that loses some stays."""
    body = [f"Line number {i} of a text that eight documents share but for one line each" for i in range(40)]
    rows = [(d, "\n".join([*body[:d], f"The line that only document {d} has, and which stays", *body[d + 1 :]])) for d in range(1, 9)]
    rows.append((None, rows[0][1]))
    own = [f"Own words of a clean document in line {i}" for i in range(20)]
    rows += [(50, "\n".join([*own, body[0]])), (51, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r.doc_id: r.n_dropped for r in lines.dedup_lines(frame).collect()}
    assert set(whole) == {None, *range(1, 9), 50, 51} and whole[50] == 0 and whole[8] == 1 and whole[3] == 39
    # Document 8 loses a line to 50, so what the others lose to 8 is not safe.
    assert {r.doc_id for r in lines.dedup_lines(frame, stubs=False).collect()} == set(whole)
    left = lines.dedup_lines(frame.where("doc_id <> 50 OR doc_id IS NULL"), stubs=False)
    assert {r.doc_id for r in left.collect()} == {None, 8, 51}


def test_bloom_has_what_it_was_given():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    bloom = lines.Bloom(1 << 14)
    bloom.add(hashes[:250])
    assert bloom.has(hashes[:250]).all() and bloom.has(hashes[250:]).mean() < 0.05
