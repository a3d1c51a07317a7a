"""Token ids of whole documents, and bounded-space online best-fit packing of their pieces."""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from aisle.llm.spans import slices
from aisle.session import checkpointed

#: Splits normalised text before the merges, as the vocabulary file states it (fixed value).
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
#: Characters that Python splits at and the vocabulary's white space does not have.
_NOT_BLANK = regex.compile("[\x1c-\x1f]")
#: Below this, lower-casing and composing need no rule beyond Python's, and the Unicode versions agree.
_PLAIN_END = "\u0250"


def _byte_of_char() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Ids of texts under a byte-level BPE file with word ends, white-space-separated piece by piece.

    The vocabulary numbers bytes first, then bytes that end a word, then the
    merges in their order, so an id is also the rank of its merge. The word end
    becomes a newline, which no word holds, and the rank-based encoder takes all
    new words of a batch in one call; ids that end a word part its result.
    Pieces with characters beyond Latin go to the file's own tokenizer. Pieces
    met before come from a bounded memo.
    """

    def __init__(self, path: str, memo: int = 600_000):
        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte = _byte_of_char()
        suffix = model["end_of_word_suffix"]
        ranks, self._ends = {}, np.zeros(len(model["vocab"]) + 1, bool)
        for token, number in model["vocab"].items():
            core = token.removesuffix(suffix)
            if set(core) <= set(byte) and not token.startswith("<|"):
                ranks.setdefault(bytes(byte[c] for c in core) + b"\n" * (core != token), number)
                self._ends[number] = core != token
        self._encode = tiktoken.Encoding(
            "words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._split = regex.compile(_PIECES + "|\n").findall
        self._size = memo
        self._memo: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _learn_words(self, words: list[str]) -> None:
        ids = np.array(self._encode("\n".join([*words, ""])), "<u4")
        data, ends = ids.tobytes(), ((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()
        self._words.update(zip(words, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=False))

    def _learn(self, pieces: list[str]) -> None:
        if odd := [p for p in pieces if not p.isascii() and max(p) >= _PLAIN_END or _NOT_BLANK.search(p)]:
            for piece, found in zip(odd, self._whole.encode_batch(odd, add_special_tokens=False), strict=True):
                self._memo[piece] = np.array(found.ids, "<u4").tobytes()
            pieces = [p for p in pieces if p not in self._memo]
        if not pieces:
            return
        parts = self._split("\n".join([*pieces, ""]).lower())
        words, memo, start = self._words, self._memo, 0
        if new := [w for w in set(parts) if w not in words and w != "\n"]:
            self._learn_words(new)
        for piece in pieces:
            end = parts.index("\n", start)
            memo[piece] = words[parts[start]] if end == start + 1 else b"".join([words[w] for w in parts[start:end]])
            start = end + 1

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        memo = self._memo
        if len(memo) > self._size or len(self._words) > self._size:
            memo.clear()
            self._words.clear()
        pieces = [[t] if _NOT_BLANK.search(t) else t.split() for t in texts]
        if new := [p for p in set().union(*pieces) if p not in memo]:
            self._learn(new)
        return [b"".join(map(memo.__getitem__, found)) for found in pieces]


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


_CUT = StructType([StructField(c, LongType()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])


def tokenised_pieces(df: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Pieces of ``capacity`` tokens at most: doc_id, piece, start, length, ids_crc32.

    Every document ends with ``end_id``; a null or empty text is that id alone.
    Only documents longer than the capacity are cut, and only their last piece
    may be shorter. Rows that repeat are packed as often as they occur.
    """
    schema = to_arrow_schema(_CUT)
    tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path).ids
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for low, high in slices([len(t) for t in texts], 4_000_000):
                for doc, ids in zip(docs[low:high], encode(texts[low:high]), strict=True):
                    ids += tail
                    for start in range(0, len(ids), width):
                        part = ids[start : start + width]
                        rows.append((doc, start // width, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return df.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, _CUT)


class BestFit:
    """A fixed number of open bins in a bitset keyed by free space.

    Bit ``f`` is set while some open bin has ``f`` places free. The best bin for
    a length is the lowest set bit at or above it. When too many are open, the
    fullest (the lowest set bit) closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, deque[int]] = {}

    def _put(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, deque()).append(number)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> int:
        queue = self.by_free[free]
        number = queue.popleft()
        if not queue:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def add(self, length: int) -> tuple[int, int]:
        """Bin and offset of an item."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if free > length:
            self._put(free - length, number)
            if self.open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free

    def left(self) -> list[tuple[int, int]]:
        """Open bins and what they hold."""
        return [(n, self.capacity - free) for free, queue in self.by_free.items() for n in queue]


_PLACED = StructType([StructField(c, LongType()) for c in ("item", "bin", "offset", "fill")])


def _round(items: DataFrame, tasks: int, number: int, capacity: int, open_bins: int) -> DataFrame:
    """Place items (item, length) in bins inside each task; rows with a null item are the bins left open.

    Items come in the order of a hash of their number, so a task that runs again
    makes the same bins.
    """
    schema = to_arrow_schema(_PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = BestFit(capacity, open_bins), None
        for batch in batches:
            task, item, length = (batch.column(i).to_pylist() for i in range(3))
            if first is None and task:
                first = (number << 56) | (task[0] << 32)
            placed = [bins.add(n) for n in length]
            yield pa.RecordBatch.from_arrays([
                pa.array(item, pa.int64()), pa.array([first + n for n, _ in placed], pa.int64()),
                pa.array([at for _, at in placed], pa.int64()), pa.nulls(len(item), pa.int64())], schema=schema)
        if left := bins.left():
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(left), pa.int64()), pa.array([first + n for n, _ in left], pa.int64()),
                pa.nulls(len(left), pa.int64()), pa.array([fill for _, fill in left], pa.int64())], schema=schema)

    order = F.xxhash64("item")
    dealt = items.repartition(tasks, order) if tasks > 1 else items.coalesce(1)
    dealt = dealt.withColumn("task", F.spark_partition_id().cast("bigint"))
    return dealt.sortWithinPartitions(order, "item").select("task", "item", "length").mapInArrow(run, _PLACED)


def best_fit(pieces: DataFrame, capacity: int = 4096, open_bins: int = 512, rows_per_task: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to ``capacity``.

    Every task packs its share online. The bins that are still open at its end
    are few (``open_bins`` a task); they are packed in further rounds, as items
    of the length that they hold, until one task is left. The result does not
    depend on which executors run the tasks: the pieces and each round are
    checkpointed, and a piece's number is its place in the checkpoint.
    """
    numbered = checkpointed(pieces.withColumn("item", F.monotonically_increasing_id()))
    items, number = numbered.select("item", "length"), 1
    count = items.count()
    rounds = []
    while True:
        tasks = -(-count // rows_per_task) or 1
        placed = checkpointed(_round(items, tasks, number, capacity, open_bins))
        rounds.append(placed.where("item IS NOT NULL"))
        if tasks == 1:
            break
        items = placed.where("item IS NULL").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        count, number = items.count(), number + 1
    where = rounds[0].select("item", "bin", "offset")
    for later in rounds[1:]:
        moved = later.select(F.col("item").alias("bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
        where = where.join(moved, "bin", "left").select(
            "item", F.coalesce("_to", "bin").alias("bin"),
            (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
    where = where.select("item", F.col("bin").alias("sequence_id"), "offset")
    return numbered.join(where, "item").drop("item")


def pack_documents(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 512,
                   key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole documents into sequences of ``capacity`` tokens: one row per piece with its sequence and offset.

    Only the numbers of a piece travel, never its ids. An empty table gives no rows.
    """
    pieces = tokenised_pieces(df, path, capacity, end_id, key, text)
    packed = best_fit(pieces, capacity, open_bins)
    return packed.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
