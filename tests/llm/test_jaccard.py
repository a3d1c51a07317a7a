import random

import numpy as np
import pytest

from aisle.llm import jaccard

BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = [x for x in (text or "").encode().translate(LOWER).translate(BLANK).split(b" ") if x]
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            if a is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    low = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            low[find(i)] = min(low.get(find(i), a), a)
    return sorted((str(a), len(sets[i]), str(low[find(i)] if a is not None else None)) for i, (a, _) in enumerate(rows))


def found(frame):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in frame.collect())


def copies(seed):
    """Families of near copies around the threshold, chains, a passage in many documents, short texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(50)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(draw.choice([5, 8, 20, 60, 200]))]
        for _ in range(12):
            text = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 12)):
                text[draw.randrange(len(text))] = word()
            if draw.random() < 0.3:
                base = text
            rows.append(" ".join(text))
    rows += [" ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))]) for _ in range(40)]
    rows += ["a b c d", "A  b\tc d", "a b", "a b", "", " ", "a b c d e"]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("words,percent,block,rounds", [(4, 85, 8, 4), (5, 80, 2, 1), (4, 85, 128, 1)])
def test_against_all_pairs(spark, words, percent, block, rounds):
    rows = copies(words)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.similar_documents(frame, words, percent, block=block, rounds=rounds)) == brute(rows, words, percent)


def test_a_leader_that_is_not_similar_hides_no_link(spark):
    # 1 shares most of its tokens with 2 and 3, not enough to link; 2 and 3 link.
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*base, *(f"x{i}" for i in range(18))])), (2, " ".join([*base, "y1 y2 y3"])),
            (3, " ".join([*base, "z1 z2 z3"]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = found(jaccard.similar_documents(frame, 4, 85, rounds=1))
    assert out == brute(rows, 4, 85) and [r[2] for r in out] == ["1", "2", "2"]


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(jaccard.similar_documents(odd, 4, 85)) == brute(rows, 4, 85)
    assert jaccard.similar_documents(nothing).count() == 0


def test_random_pairs_at_the_threshold_share_a_column():
    draw = np.random.default_rng(1)
    limit = jaccard.windows_needed(0.8)
    for _ in range(2_000):
        n = int(draw.choice([6, 10, 30, 500]))
        union = np.unique(draw.integers(0, 1 << 63, n).astype(np.uint64))
        gone = draw.choice(len(union), int(0.2 * len(union)), replace=False)
        side = draw.random(len(gone)) < 0.5
        a, b = np.delete(union, gone[side]), np.delete(union, gone[~side])
        assert jaccard.similar(a, b, 80)
        assert np.intersect1d(jaccard.columns_of(a, limit), jaccard.columns_of(b, limit)).size
