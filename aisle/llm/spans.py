"""Byte-level helpers that work on whole batches of texts with numpy.

Texts of a batch are laid end to end in one byte array, with a blank after
each. Any span of it has a 64-bit hash that costs two array reads: the
difference of two prefix sums of a polynomial, scaled back by the inverse
power. The multiplier is odd, so the inverse exists modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: The blank characters of the word pattern ``[^\\x20\\x09-\\x0D]+``.
BLANKS = b"\t\n\x0b\x0c\r "
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def texts_of(column: pa.Array) -> list[bytes]:
    """Bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold ``limit`` bytes at most, or a single text."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


class Spans:
    """Texts laid end to end, with hashes of any span."""

    def __init__(self, texts: Sequence[bytes], lower: bool = False):
        joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.bytes = _LOWER[joined] if lower else joined
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        up, self._down = _powers(len(joined) + 1)
        self._prefix = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((self.bytes + np.uint64(1)) * up[: len(joined)], out=self._prefix[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._prefix[ends] - self._prefix[starts]) * self._down[starts])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        word = ~_BLANK[self.bytes]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, np.searchsorted(self.ends, starts, side="right")
