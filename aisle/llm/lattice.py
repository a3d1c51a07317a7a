"""Trie of distinct words with unigram forward scores, one dynamic program per shared prefix.

The trie is built level by level over all distinct words of a batch: the nodes
of a level are the distinct prefixes of that length, found by their hashes. At
every node the forward score looks back over all vocabulary pieces that end
there, once for all words that share the prefix.
"""

from __future__ import annotations

import copy
import math
from functools import lru_cache

import numpy as np
import sentencepiece

from aisle.llm.spans import Spans

#: Words longer than this (in bytes) run one at a time, so that the trie stays shallow.
_DEEP = 48
_MARK = "▁"


class Pieces:
    """Pieces by the hash of their bytes, with a log-probability each.

    The scores of the model file are negative merge ranks. A piece's weight
    follows Zipf's law over them, 1 / (rank + 1). Every single byte is a piece
    too, with the file's byte pieces sharing the weight of one piece after the
    last rank. ``inside`` holds pieces as they are, ``initial`` those that open
    a word, without their mark; ``mark`` is the score of the mark alone, and
    ``end`` the log-probability of the end of a text.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scored = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        # Runs of marks cannot occur: words are split at blanks.
        scored = {p: r for p, r in scored.items() if _MARK not in p[1:]}
        weights = {p: 1.0 / (rank + 1.0) for p, rank in scored.items()}
        spare = min(weights.values())
        total = sum(weights.values()) + 2 * spare
        logp = {p: math.log(w / total) for p, w in weights.items()}
        byte = math.log(spare / total / 256)
        self.end = math.log(spare / total)
        self.mark = logp.pop(_MARK)
        self.inside = {bytes([b]): byte for b in range(256)}
        self.inside |= {p.encode(): s for p, s in logp.items() if p[0] != _MARK}
        self.initial = {p[1:].encode(): s for p, s in logp.items() if p[0] == _MARK}
        self.longest = max(map(len, [*self.inside, *self.initial]))
        self._inside, self._initial = _Table(self.inside), _Table(self.initial)
        # The numbers that ``step`` gives, by the bytes of a piece.
        self.numbers = ({name: i for i, name in enumerate(self._inside.names)},
                        {name: i for i, name in enumerate(self._initial.names, len(self.inside))})

    def step(self, hashes: np.ndarray, from_start: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Pieces among spans: their places, numbers and scores, and whether they open the word."""
        where, which = self._inside.find(hashes)
        found = [(where, which, self._inside.scores[which], False)]
        if from_start:
            where, which = self._initial.find(hashes)
            found.append((where, which + len(self.inside), self._initial.scores[which], True))
        return found

    def __len__(self) -> int:
        """Pieces that ``step`` numbers, and the mark as the last."""
        return len(self.inside) + len(self.initial) + 1

    def learned(self, expected: np.ndarray, trust: float = 1_000.0) -> Pieces:
        """These pieces with weights from expected counts, to which the old weights add ``trust`` counts."""
        n = len(self.inside)
        old = np.concatenate([self._inside.scores, self._initial.scores, [self.mark]])
        weights = expected + trust * np.exp(old)
        rest = trust * math.exp(self.end)
        scores = np.log(weights / (weights.sum() + rest))
        new = copy.copy(self)
        new._inside, new._initial = self._inside.rescored(scores[:n]), self._initial.rescored(scores[n:-1])
        new.mark, new.end = float(scores[-1]), math.log(rest / (weights.sum() + rest))
        new.inside = dict(zip([self._inside.names[i] for i in range(n)], scores[:n].tolist(), strict=True))
        new.initial = dict(zip(self._initial.names, scores[n:-1].tolist(), strict=True))
        return new


class _Table:
    """Scores by hash; a bitmap turns most misses away before the search."""

    def __init__(self, scores: dict[bytes, float]):
        spans = Spans(list(scores))
        keys = spans.hashes(spans.starts, spans.ends - 1)
        order = np.argsort(keys)
        self.names = [spans.bytes[spans.starts[i] : spans.ends[i] - 1].tobytes() for i in order]
        self.keys, self.scores = keys[order], np.fromiter(scores.values(), float, len(scores))[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[maybe]
        return maybe[hit], at[hit]

    def rescored(self, scores: np.ndarray) -> _Table:
        new = copy.copy(self)
        new.scores = scores
        return new


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _scalar(pieces: Pieces, word: bytes, marginal: bool, expected: np.ndarray | None = None) -> tuple[float, int]:
    """One word alone: the best (or summed) log score, and the fewest tokens of the best.

    ``expected`` takes the expected uses of the pieces, as in ``forward``.
    """
    score, count = [pieces.mark], [1]
    for end in range(1, len(word) + 1):
        best, tokens = -math.inf, 0
        for start in range(max(0, end - pieces.longest), end):
            part = word[start:end]
            options = [(pieces.inside.get(part), score[start], count[start])]
            if start == 0:
                options.append((pieces.initial.get(part), 0.0, 0))
            for own, before, held in options:
                if own is None:
                    continue
                value = before + own
                if marginal:
                    best = value if best == -math.inf else max(best, value) + math.log1p(math.exp(-abs(best - value)))
                elif value > best or value == best and held + 1 < tokens:
                    best, tokens = value, held + 1
        score.append(best)
        count.append(tokens)
    if expected is not None:
        _scalar_uses(pieces, word, score, expected)
    return score[-1], count[-1]


def _scalar_uses(pieces: Pieces, word: bytes, score: list[float], expected: np.ndarray) -> None:
    """Add the expected uses of pieces by one word; arcs are looked up again, so only the nodes are held."""
    inside, initial = pieces.numbers
    flow = [0.0] * len(word) + [1.0]
    for end in range(len(word), 0, -1):
        for start in range(max(0, end - pieces.longest), end):
            part = word[start:end]
            if part in inside:
                used = flow[end] * math.exp(score[start] + pieces.inside[part] - score[end])
                expected[inside[part]] += used
                flow[start] += used
            if start == 0 and part in initial:
                expected[initial[part]] += flow[end] * math.exp(pieces.initial[part] - score[end])
    expected[-1] += flow[0]


def forward(pieces: Pieces, spans: Spans, starts: np.ndarray, ends: np.ndarray,
            marginal: bool, expected: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log score and number of tokens of each word (tokens only for the best segmentation).

    ``marginal`` adds up the probabilities of all segmentations; otherwise the
    best one counts, and of equally good ones the one with the fewest tokens.
    With ``marginal``, the expected number of uses of each piece over all words
    is added to ``expected``: mass flows from the words' nodes back along the
    arcs, once per shared prefix, and in words of more than 48 bytes one by one.
    """
    sizes = ends - starts
    scores, tokens = np.zeros(len(starts)), np.zeros(len(starts), np.int32)
    for i in np.flatnonzero(sizes > _DEEP):
        scores[i], tokens[i] = _scalar(pieces, spans.bytes[starts[i] : ends[i]].tobytes(), marginal, expected)
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -_DEEP) :]
    starts, sizes = starts[order], sizes[order]
    alive = [len(order)]  # words that reach each level; longest first, so they are the first ones
    level_score, level_count = [np.array([pieces.mark])], [np.array([1], np.int32)]
    node_of = [np.zeros(len(order), np.int32)]  # node of each word at each level
    arcs: list[list[tuple]] = [[]]  # into the nodes of each level
    ending: list[np.ndarray] = [np.zeros(1)]
    for depth in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
        n = int(np.searchsorted(-sizes, -depth, side="right"))
        alive.append(n)
        begin = starts[:n]
        prefix = spans.hashes(begin, begin + depth)
        _, first, node = np.unique(prefix, return_index=True, return_inverse=True)
        value = np.full(len(first), -np.inf)
        count = np.zeros(len(first), np.int32)
        at = begin[first]
        arcs.append([])
        for back in range(1, min(depth, pieces.longest) + 1):
            parent = node_of[depth - back][first]
            for hit, which, own, opens in pieces.step(spans.hashes(at + (depth - back), at + depth), back == depth):
                before = 0.0 if opens else level_score[depth - back][parent[hit]]
                held = 0 if opens else level_count[depth - back][parent[hit]]
                new = before + own
                if marginal:
                    value[hit] = np.logaddexp(value[hit], new)
                    if expected is not None:
                        arcs[depth].append((back, hit, None if opens else parent[hit], which, new))
                else:
                    better = (new > value[hit]) | (new == value[hit]) & (held + 1 < count[hit])
                    value[hit[better]] = new[better]
                    count[hit[better]] = (held + 1)[better] if np.ndim(held) else held + 1
        level_score.append(value)
        level_count.append(count)
        node_of.append(node.astype(np.int32))
        done = np.flatnonzero(sizes[:n] == depth)
        scores[order[done]] = value[node[done]]
        tokens[order[done]] = count[node[done]]
        ending.append(np.bincount(node[done], minlength=len(first)).astype(float))
    if expected is not None:
        for depth in range(len(level_score) - 1, 0, -1):
            for back, hit, parent, which, value in arcs[depth]:
                flow = ending[depth][hit] * np.exp(value - level_score[depth][hit])
                expected += np.bincount(which, flow, minlength=len(expected))
                if parent is not None:
                    ending[depth - back] += np.bincount(parent, flow, minlength=len(ending[depth - back]))
        expected[-1] += ending[0][0]
    return scores, tokens
