import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from aisle.llm import lattice, lm_score

PATH = public_tokenizers.path("piece_bpe_32k.model")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split(text):
    out = (text or "").encode().translate(LOWER).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ")
    return [w for w in out if w]


def learned(words):
    """One step of expectation and maximisation, by listing all arcs of each word."""
    pieces = lattice.pieces_of(PATH)
    uses = np.zeros(len(pieces))
    number = {("inside", n): i for i, n in enumerate(pieces._inside.names)}
    number |= {("initial", n): len(pieces.inside) + i for i, n in enumerate(pieces._initial.names)}
    for word in words:
        n = len(word)
        arcs = [(-1, 0, pieces.mark, len(uses) - 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + pieces.longest) + 1):
                if word[i:j] in pieces.inside:
                    arcs.append((i, j, pieces.inside[word[i:j]], number["inside", word[i:j]]))
                if i == 0 and word[:j] in pieces.initial:
                    arcs.append((-1, j, pieces.initial[word[:j]], number["initial", word[:j]]))
        ahead, behind = Counter({-1: 1.0}), Counter({n: 1.0})
        for i, j, s, _ in sorted(arcs, key=lambda a: a[1]):
            ahead[j] += ahead[i] * math.exp(s)
        for i, j, s, _ in sorted(arcs, key=lambda a: -a[0]):
            behind[i] += behind[j] * math.exp(s)
        for i, j, s, k in arcs:
            uses[k] += ahead[i] * math.exp(s) * behind[j] / ahead[n]
    return pieces.learned(uses)


def brute(rows, memory):
    fold = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    count = Counter(w for (_, t), held in zip(rows, fold, strict=True) if not held for w in [*split(t), None])
    tokens, types = sum(count.values()), len(count)
    pieces = learned([w for w in count if w is not None and len(w) <= 48])
    memo, out = {}, []
    for (doc, text), held in zip(rows, fold, strict=True):
        words = split(text)
        base = sum(math.log10((count[w] + 1) / (tokens + types + 1)) for w in [*words, None])
        score, seen = 0.0, Counter()
        for i, w in enumerate([*words, None]):
            if w is None:
                p = count[None] / (tokens + types) if tokens else math.exp(pieces.end)
            else:
                if w not in memo:
                    memo[w] = lattice._scalar(pieces, w, True)[0]
                p = ((count[w] + types * math.exp(memo[w])) / (tokens + types) if tokens
                     else math.exp(memo[w]) * (1 - math.exp(pieces.end)))
            log = math.log10((memory * p + seen[w]) / (memory + i)) if p else (
                math.log10(memory) + memo[w] / math.log(10) - math.log10(memory + i)
                + (math.log10(types / (tokens + types)) if tokens else 0))
            score += log
            seen[w] += w is not None
        out.append((str(doc), held, len(words) + 1, sum(count[w] > 0 for w in [*words, None]), tokens, base, score))
    return sorted(out)


def same(frame, expected):
    rows = sorted((str(r[0]), *r[1:]) for r in frame.collect())
    assert len(rows) == len(expected)
    for a, b in zip(rows, expected, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-7)


def test_documents_and_blocks(documents):
    rows = [(r.doc_id, r.text) for r in documents.where("doc_id < 100").collect()]
    some = documents.where("doc_id < 100")
    expected = brute(rows, 1_000.0)
    same(lm_score.score_documents(some, PATH), expected)
    # Neither counts nor weights depend on the blocks.
    cut = sorted((str(r[0]), *r[1:]) for r in lm_score.score_documents(some, PATH, block_bytes=50_000).collect())
    assert [r[:5] for r in cut] == [r[:5] for r in expected]
    assert [r[5] for r in cut] == pytest.approx([r[5] for r in expected], rel=1e-9)
    assert [r[6] for r in cut] == pytest.approx([r[6] for r in expected], rel=1e-7)


def test_known_words_are_likelier_than_under_the_base_and_pieces_learn(spark, folder):
    docs = spark.read.parquet(folder.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = [r for r in lm_score.score_documents(docs, PATH).collect() if r.held_out]
    known = [r for r in held if r.n_known >= 0.97 * r.n_tokens]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)
    plain = lattice.pieces_of(PATH)
    words = {w for (t,) in docs.select("text").limit(300).collect() for w in split(t) if len(w) <= 48}
    better = learned(sorted(words)[::2])
    other = sorted(words)[1::2]
    total = lambda p: sum(lattice._scalar(p, w, True)[0] for w in other)
    assert total(better) > 0.9 * total(plain) and total(better) > total(plain)


def test_odd_rows(odd, nothing, spark):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(lm_score.score_documents(odd, PATH), brute(rows, 1_000.0))
    assert lm_score.score_documents(nothing, PATH).count() == 0
    fold = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    only = [(i, "No training text, no counts.") for i in fold[:5]]
    same(lm_score.score_documents(spark.createDataFrame(only, "doc_id long, text string"), PATH), brute(only, 1_000.0))


def test_probabilities_of_one_word_texts_stay_under_one(spark):
    # Every text of one word over two letters and up to three of them, next to a little corpus.
    words = ["".join(w) for n in (1, 2, 3) for w in __import__("itertools").product("ab", repeat=n)]
    rows = [(i, w) for i, w in enumerate(words)] + [(1000 + i, "ab a b") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in lm_score.score_documents(frame, PATH).collect()}
    assert sum(10 ** found[i] for i in range(len(words))) < 1


def test_scores_do_not_depend_on_blocks_or_slices(documents):
    rows = [(r.doc_id, r.text) for r in documents.where("doc_id < 100").collect()]
    some = documents.where("doc_id < 100")
    expected = brute(rows, 1_000.0)
    same(lm_score.score_documents(some, PATH, block_bytes=20_000), expected)
    same(lm_score.score_documents(some, PATH, block_bytes=50_000, slice_bytes=5_000), expected)


def test_rows_without_a_key_are_spread_over_blocks(spark):
    texts = [f"shared words and number {i} of these rows" for i in range(300)]
    one = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    few, many = (lm_score.score_documents(one, PATH, block_bytes=size).collect() for size in (8_000_000, 500))
    assert len(few) == len(many) == 300
    assert sorted(r.score for r in many) == pytest.approx(sorted(r.score for r in few), rel=1e-9)


def test_long_words_teach_the_pieces(spark):
    long = ["abcdefgh" * 9, "international" * 5 + "s", "y" * 49]
    words = [*long, "plain", "words", "x" * 48, "short"]
    fold = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(fold[i], w) for i, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    pieces, want = lattice.pieces_of(PATH), learned([w.encode() for w in words])
    uses = np.zeros(len(pieces))
    for batch in lm_score._piece_uses(PATH, 200)(iter(
            [pa.RecordBatch.from_arrays([pa.array([w.encode() for w in words], pa.binary())], ["spelt"])])):
        uses[batch.column(0).to_numpy()] += batch.column(1).to_numpy()
    got = pieces.learned(uses)
    assert got.mark == pytest.approx(want.mark, rel=1e-9) and got.inside == pytest.approx(want.inside, rel=1e-9)
    assert got.initial == pytest.approx(want.initial, rel=1e-9)
    # Seven words and seven ends, of eight types; a word has count 1 and what its pieces give.
    for r in lm_score.score_documents(frame, PATH).collect():
        by_pieces = math.exp(lattice._scalar(want, dict(rows)[r.doc_id].encode(), True)[0])
        assert 10 ** r.score == pytest.approx((1 + 8 * by_pieces) / 22 * 7 / 22 * 1_000 / 1_001, rel=1e-6)


def test_uses_of_a_very_long_word_spell_it():
    pieces, word = lattice.pieces_of(PATH), "日本語 and more words".replace(" ", "").encode() * 300
    uses = np.zeros(len(pieces))
    lattice._scalar(pieces, word, True, uses)
    names = [*pieces._inside.names, *pieces._initial.names, b""]
    assert sum(u * len(n) for u, n in zip(uses, names, strict=True)) == pytest.approx(len(word), rel=1e-9)
