"""Line de-duplication with two Bloom filters and an exact confirmation of suspected repeats."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from aisle.session import checkpointed

#: Stripped at both ends of a line (fixed value).
BLANKS = b" \t\n\x0b\x0c\r"
_SEGMENT = 1 << 16  # bytes of a filter that travel as one row


class Bloom:
    """Bits set by 64-bit hashes, four to a hash; the size is a power of two."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) & self.mask for i in range(4)])

    def add(self, hashes: np.ndarray) -> None:
        at = self.places(hashes).ravel()
        np.bitwise_or.at(self.bytes, (at >> np.uint64(3)).astype(np.int64),
                         np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes)
        held = self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
        return (held & 1).all(axis=0)


def line_key(line: bytes, least: int) -> bytes | None:
    """The line without blanks at its ends and with A-Z lower-cased, if it has ``least`` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def keys_of(text: str | None, least: int) -> list[bytes | None]:
    """Key of each line of a text; None for lines too short to be compared. A null text is one empty line."""
    return [line_key(x, least) for x in (text or "").encode().split(b"\n")]


def _batches(batches: Iterator[pa.RecordBatch], least: int, rows: int = 512):
    """Documents and, for each, its distinct keys; then their hashes and the document number of each."""
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1)
        for low in range(0, len(docs), rows):
            keys = [list({k for k in keys_of(t.as_py(), least) if k}) for t in texts[low : low + rows]]
            flat = [k for some in keys for k in some]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
            owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield docs[low : low + rows], flat, hashes, owner


_FILTER = StructType([StructField("segment", LongType()), StructField("once", BinaryType()),
                      StructField("twice", BinaryType())])


def repeat_filter(docs: DataFrame, bits: int, least: int) -> bytes:
    """Filter of the key hashes that were seen in two documents or more (and some others).

    Every task fills two filters of its own, hashes seen once and hashes seen
    again. They travel as compressed segments; where segments meet, what one has
    seen once and the rest too is seen twice. So the filters never miss a
    repeat. The merged filter has a fixed size and comes to the driver.
    """
    schema = to_arrow_schema(_FILTER)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Bloom(bits), Bloom(bits)
        for _, _, hashes, _ in _batches(batches, least):
            found, count = np.unique(hashes, return_counts=True)
            twice.add(found[(count > 1) | once.has(found)])
            once.add(found)
        for at in range(0, bits // 8, _SEGMENT):
            seen, again = once.bytes[at : at + _SEGMENT], twice.bytes[at : at + _SEGMENT]
            if seen.any():
                yield pa.RecordBatch.from_pylist([{
                    "segment": at // _SEGMENT, "once": zlib.compress(seen.tobytes(), 1),
                    "twice": zlib.compress(again.tobytes(), 1)}], schema=schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, once, twice = None, None, None

        def row():
            return pa.RecordBatch.from_pylist([{
                "segment": segment, "once": None, "twice": zlib.compress(twice.tobytes(), 1)}], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                seen = np.frombuffer(zlib.decompress(r["once"]), np.uint8)
                again = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
                if r["segment"] != segment:
                    if segment is not None and twice.any():
                        yield row()
                    segment, once, twice = r["segment"], seen, again
                else:
                    once, twice = once | seen, twice | again | (once & seen)
        if segment is not None and twice.any():
            yield row()

    parts = docs.mapInArrow(fill, _FILTER).repartition("segment").sortWithinPartitions("segment")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.mapInArrow(merge, _FILTER).select("segment", "twice").collect():
        part = np.frombuffer(zlib.decompress(r.twice), np.uint8)
        out[r.segment * _SEGMENT : r.segment * _SEGMENT + len(part)] = part
    return out.tobytes()


def filter_bits(lines: int, most: int) -> int:
    """Sixteen bits for each line, a power of two between 2**19 and ``most``."""
    return min(most, 1 << max(19, (16 * max(lines, 1) - 1).bit_length()))


_SUSPECT = StructType([StructField("doc_id", LongType()), StructField("key", StringType())])


def lost_lines(docs: DataFrame, least: int, documents: int, most_bits: int = 1 << 28) -> DataFrame:
    """Keys that a document loses, and who keeps them: doc_id, key, keeper. ``docs`` has doc_id and text.

    Only keys that the filter suspects to repeat are shuffled. They are counted
    exactly, by their text; the largest doc_id that holds a key keeps it. The filter is at most 2**28 bits (32 MB). Beyond some 10**8 lines it fills up:
    then more keys are suspected and shuffled, and the result is the same.
    """
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = docs.agg(F.sum(breaks + 1)).first()[0]
    bits = filter_bits(lines or 0, most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, bits, least))
    schema = to_arrow_schema(_SUSPECT)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Bloom(bits, sent.value)
        for ids, keys, hashes, owner in _batches(batches, least):
            hit = np.flatnonzero(repeats.has(hashes))
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in owner[hit]], pa.int64()),
                pa.array([keys[i].decode() for i in hit], pa.string())], schema=schema)

    held = docs.mapInArrow(suspects, _SUSPECT).groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    counted = held.groupBy("key").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"))
    repeated = counted.where(F.col("documents") >= documents)
    return held.join(repeated, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "key", "keeper")


def dropped_keys(lost: DataFrame) -> DataFrame:
    """Keys that a document loses: doc_id, keys, keepers (arrays)."""
    return lost.groupBy("doc_id").agg(
        F.collect_list("key").alias("keys"), F.collect_set("keeper").alias("keepers"))


def weakly_kept(lost: DataFrame, salts: int = 32) -> DataFrame:
    """Keys that a document loses to documents which lose lines themselves: doc_id, weak (array of keys).

    One document can keep lines for very many; it is joined under several salts.
    """
    losers = lost.select(F.col("doc_id").alias("keeper")).distinct()
    keepers = lost.select("keeper").distinct().join(losers, "keeper", "left_semi").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lost.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(salts)).cast("int"))
    return salted.join(keepers, ["keeper", "salt"], "left_semi").groupBy("doc_id").agg(F.collect_list("key").alias("weak"))


def _words_digest(text):
    """Digest of the words of a text between blanks, with A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.md5(F.trim(F.regexp_replace(F.translate(text, upper, upper.lower()), "[ \\t\\n\\x0b\\f\\r]+", " ")))


def larger_copies(docs: DataFrame) -> DataFrame:
    """Texts that a larger doc_id holds too: doc_id, copies (array of words, the digest, and last, the largest id)."""
    held = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", _words_digest(F.col("text")).alias("words")).distinct()
    last = held.groupBy("words").agg(F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(last, "words").where("doc_id < last").groupBy("doc_id").agg(
        F.collect_list(F.struct("words", "last")).alias("copies"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5,
                keep: list[str] | None = None, stubs: bool = True, scrap: float = 0.1) -> DataFrame:
    """Drop repeated lines: the columns in ``keep``, doc_id, text (what stays), n_lines, n_dropped.

    A line is dropped if its key (blanks stripped at both ends, A-Z lower-cased)
    has at least ``least`` code points and at least ``documents`` documents hold
    it, except in the document with the largest id among them, which keeps all
    its copies. Rows with the same doc_id are one document and lose the same
    lines; rows with a null doc_id are one document, the smallest. A null text
    is one empty line and stays null.

    Without ``stubs``, three kinds of rows that lost lines go as a whole: what has
    no word left; a copy (same words) of the largest document with its text,
    if that one keeps a line which the copy lost (copies that lost the same lines
    as that document stay, as equal texts); and what less than ``scrap`` of its
    words would be lost with, counting the lines it still has and those kept by documents
    that lose lines themselves. Such a row is a near copy, of which only the few
    lines that differ would stay. Rows without a doc_id are no scraps.
    """
    keep = [c for c in keep or [] if c not in (key, text)]
    own = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), *own)
    rows = lost_lines(docs.select("doc_id", "text"), least, documents)
    if stubs:
        lost = dropped_keys(rows).withColumn("weak", F.lit(None).cast("array<string>"))
    else:
        rows = checkpointed(rows)
        lost = dropped_keys(rows).join(weakly_kept(rows), "doc_id", "left").join(larger_copies(docs), "doc_id", "left")
    lost = lost.withColumnRenamed("doc_id", "_of")
    joined = docs.join(lost, F.col("doc_id").eqNullSafe(F.col("_of")), "left").drop("_of")
    if not stubs:
        own_words = _words_digest(F.col("text"))
        stub = F.exists("copies", lambda c: F.array_contains("keepers", c["last"]) & (c["words"] == own_words))
        joined = joined.where(F.col("copies").isNull() | F.col("text").isNull() | ~stub)
    fields = [joined.schema[f"_keep{i}"] for i in range(len(keep))]
    schema = StructType([
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("n_lines", LongType()),
        StructField("n_dropped", LongType()), StructField("share", DoubleType()), *fields])
    arrow = to_arrow_schema(schema)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, drops, shares = [], [], [], []
            for text, keys, weak in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if not keys or text is None:
                    counts.append((text or "").count("\n") + 1)
                    drops.append(0)
                    shares.append(1.0)
                    texts.append(text)
                    continue
                gone = {k.encode() for k in keys}
                rows = text.encode().split(b"\n")
                stay = [x for x in rows if line_key(x, least) not in gone]
                counts.append(len(rows))
                drops.append(len(rows) - len(stay))
                texts.append(b"\n".join(stay).decode())
                if stubs:
                    shares.append(1.0)
                    continue
                safe = gone - {k.encode() for k in weak or []}
                words = [(len(x.split()), line_key(x, least) in safe) for x in rows]
                shares.append(sum(n for n, kept in words if not kept) / max(1, sum(n for n, _ in words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(drops, pa.int64()), pa.array(shares, pa.float64()), *batch.columns[4:]], schema=arrow)

    out = joined.select("doc_id", "text", "keys", "weak", *[f.name for f in fields]).mapInArrow(rewrite, schema)
    if not stubs:
        out = out.where(F.col("doc_id").isNull() | (F.col("share") >= scrap)).where((F.col("n_dropped") == 0) | F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]"))
    return out.select("doc_id", "text", "n_lines", "n_dropped",
                      *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)])
