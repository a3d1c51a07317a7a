import math

import public_tokenizers
import pytest

from aisle.llm import lattice, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lattice.pieces_of(PATH)


def split(text):
    return [w for w in (text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]


def brute(pieces, word):
    """All segmentations of a short word, as (log score, tokens)."""

    def rest(at, first):
        if at == len(word):
            return [(0.0, 0)]
        out = []
        for end in range(at + 1, len(word) + 1):
            own = []
            if (s := pieces.inside.get(word[at:end])) is not None:
                own.append((s + (pieces.mark if first else 0), 1 + first))
            if first and (s := pieces.initial.get(word[at:end])) is not None:
                own.append((s, 1))
            if own:
                later = rest(end, 0)
                out += [(s + t, n + m) for s, n in own for t, m in later]
        return out

    return rest(0, 1)


def test_trie_scores_equal_all_segmentations(pieces):
    words = ["the", "thhaen", "a", "élle", "日本", "don't", "THE!!", "x1y2", "😀a", "ontheonthe"]
    spans = lattice.Spans([w.encode() for w in words])
    for marginal in (False, True):
        scores, tokens = lattice.forward(pieces, spans, *spans.words()[:2], marginal)
        for word, score, count in zip(words, scores, tokens, strict=True):
            found = brute(pieces, word.encode())
            if marginal:
                assert math.isclose(score, math.log(sum(math.exp(s) for s, _ in found)), rel_tol=1e-9)
            else:
                best = max(s for s, _ in found)
                assert math.isclose(score, best, rel_tol=1e-9)
                assert count in {n for s, n in found if math.isclose(s, best, rel_tol=1e-12)}


def test_weights_are_a_distribution(pieces):
    # Pieces with the mark, pieces without it, the mark alone and the end of the text share one unit.
    total = sum(math.exp(s) for s in [*pieces.inside.values(), *pieces.initial.values(), pieces.mark, pieces.end])
    single = sum(math.exp(pieces.end) / 256 for _ in range(256))
    assert total == pytest.approx(1.0, abs=single * 256) and total <= 1.0 + 1e-12


def test_documents(documents, pieces):
    rows = documents.select("doc_id", "text").collect()
    memo = {}
    for r in rows:
        for w in split(r.text):
            if w not in memo:
                memo[w] = lattice._scalar(pieces, w, False)[1]
    expected = sorted((r.doc_id, len(split(r.text)), sum(memo[w] for w in split(r.text))) for r in rows)
    for size in (6_000_000, 20_000):
        assert sorted(map(tuple, token_counts.count_tokens(documents, PATH, slice_bytes=size).collect())) == expected


def test_odd_rows(odd, nothing, pieces):
    expected = sorted((str(r.doc_id), len(split(r.text)),
                       sum(lattice._scalar(pieces, w, False)[1] for w in split(r.text))) for r in odd.collect())
    assert sorted((str(a), b, c) for a, b, c in token_counts.count_tokens(odd, PATH).collect()) == expected
    assert token_counts.count_tokens(nothing, PATH).count() == 0
