"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of all hashes.

A sketch keeps the same part of every shingle set, however large, so sketches of
very unequal documents can be compared, and sketches of parts merge into the
sketch of the whole. A floor keeps the smallest hashes of a short document: its
sketch reaches up to a limit of its own (the largest hash of which it is sure),
and two sketches are compared below the smaller limit.
"""

import bisect
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from aisle.llm.sharding import numbered

#: A hash is the first 60 bits of an MD5.
BITS = 60
TOP = (1 << BITS) - 1


@dataclass(frozen=True)
class Scale:
    """``words``: words of a shingle; ``fraction``: part of the hashes that is kept; ``floor``: hashes kept at least."""

    words: int = 5
    fraction: float = 1 / 16
    floor: int = 32

    @property
    def threshold(self) -> int:
        """Largest hash that is always kept."""
        return int(self.fraction * (1 << BITS)) - 1


@dataclass(frozen=True)
class Sketch:
    """Hashes up to ``limit`` in ascending order, and the number of distinct shingles."""

    limit: int
    hashes: np.ndarray
    shingles: int

    def text(self) -> str:
        """Limit and hashes, 15 hexadecimal digits each."""
        return f"{self.limit:015x}:" + "".join(f"{h:015x}" for h in self.hashes.tolist())


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; fewer words are one run, none are none."""
    count = len(words) - size + 1
    runs = [b" ".join(words[i : i + size]) for i in range(count)] if count > 0 else [b" ".join(words)] if words else []
    digests = b"".join([hashlib.md5(r, usedforsecurity=False).digest()[:8] for r in runs])
    return (np.frombuffer(digests, ">u8") >> np.uint64(64 - BITS)).astype(np.int64)


def sketched(hashes: np.ndarray, scale: Scale) -> Sketch:
    """Sketch of all the hashes of a document."""
    known = np.unique(hashes)
    limit = TOP if len(known) <= scale.floor else max(scale.threshold, int(known[scale.floor - 1]))
    return Sketch(limit, known[: np.searchsorted(known, limit, "right")], len(known))


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated Jaccard similarity. Two documents without words are alike (1)."""
    limit = min(a.limit, b.limit)
    x, y = (s.hashes[: np.searchsorted(s.hashes, limit, "right")] for s in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    return common / union if union else 1.0


class Hasher:
    """Words (between ASCII blanks, A-Z lower-cased) and shingle hashes of a text and of an edited form of it."""

    def __init__(self, text: str, scale: Scale):
        self.text, self.scale = text, scale
        self.words = text.encode().lower().split()
        self.hashes = shingle_hashes(self.words, scale.words)
        self.sketch = sketched(self.hashes, scale)

    def edited(self, head: str, tail: str) -> Sketch:
        """Sketch of ``head + tail`` where ``head`` is the start of this text; shingles of the head are not hashed again."""
        words = (head + tail).encode().lower().split()
        size = self.scale.words
        # The last word of the head may go on differently.
        same = max(0, len(head.encode().split()) - 1) - size + 1
        if same < 1:
            return sketched(shingle_hashes(words, size), self.scale)
        return sketched(np.concatenate([self.hashes[:same], shingle_hashes(words[same:], size)]), self.scale)


SKETCH = StructType([StructField("limit", LongType()), StructField("hashes", ArrayType(LongType())),
                     StructField("n_shingles", LongType())])


def sketch_documents(df: DataFrame, key: str = "doc_id", text: str = "text", scale: Scale = Scale()) -> DataFrame:
    """doc_id and sketch (limit, hashes ascending, n_shingles) of every row. A null text is empty; it has no hash."""
    schema = StructType([StructField("doc_id", LongType()), StructField("sketch", SKETCH)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Hasher(t.as_py() or "", scale).sketch for t in batch.column(1)]
            rows = [{"limit": s.limit, "hashes": s.hashes, "n_shingles": s.shingles} for s in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, arrow.field(1).type)], schema=arrow)

    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _below(sketch: Column, limit: Column) -> Column:
    return F.filter(sketch["hashes"], lambda h: h <= limit)


def jaccard(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketch columns; 1 where neither document has words."""
    limit = F.least(a["limit"], b["limit"])
    x, y = _below(a, limit), _below(b, limit)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the shingles of ``a`` that ``b`` has; null where no hash of ``a`` is below the common limit.

    The sizes may differ by any factor: both sketches hold the same part of the
    hashes, so the larger document does not crowd out the smaller one's.
    """
    limit = F.least(a["limit"], b["limit"])
    x = _below(a, limit)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, _below(b, limit))) / F.size(x))


def merge(sketches: DataFrame, *group: str, scale: Scale = Scale()) -> DataFrame:
    """Sketch of the union of the documents of each group, as rows: the group, limit and hash.

    ``sketches`` has the group columns and ``sketch``. What comes out equals the
    sketch of all their shingles, in whatever order parts are merged. It has one
    row per kept hash, since a group may be any share of the corpus; a group
    without words has one row with a null hash.
    """
    held = sketches.select(*group, F.col("sketch.limit").alias("limit"), F.explode_outer("sketch.hashes").alias("hash"))
    known = held.groupBy(*group, "hash").agg(F.min("limit").alias("limit"))
    bounds = known.groupBy(*group).agg(F.min("limit").alias("sure"))
    # The floor needs the smallest hashes of a group; the rank stops at it inside each task.
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("hash"))
    low = known.where("hash IS NOT NULL").withColumn("_no", rank).where(F.col("_no") <= scale.floor + 1)
    at = low.groupBy(*group).agg(F.count("*").alias("_many"), F.max(F.when(F.col("_no") <= scale.floor, F.col("hash"))).alias("_last"))
    limits = bounds.join(at, [*group], "left").select(
        *group, F.when(F.coalesce("_many", F.lit(0)) <= scale.floor, F.col("sure")).otherwise(
            F.least("sure", F.greatest(F.lit(scale.threshold), "_last"))).alias("limit"))
    kept = known.drop("limit").join(limits, [*group]).where("hash IS NULL OR hash <= limit")
    some = kept.where("hash IS NOT NULL").select(*group, "limit", "hash")
    wordless = limits.join(some.select(*group).distinct(), [*group], "left_anti").select(
        *group, "limit", F.lit(None).cast("bigint").alias("hash"))
    return some.unionByName(wordless)


_COMPARED = StructType([
    StructField("doc_id", LongType()), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
    StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()),
    StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
    StructField("n_shingles", LongType())])


def compare_edits(df: DataFrame, key: str = "doc_id", text: str = "text", scale: Scale = Scale(),
                  part_bytes: int = 16 << 20, most_parts: int = 4_096) -> DataFrame:
    """Fingerprints of every document and of an edited form, with likenesses: one row per row of ``df``.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_shingles. The edited text has
    its last quarter (rounded down, in code points) replaced by as many first
    code points of the next document, or all it has. Next is by ascending id;
    null ids come first, rows with one id follow each other by the MD5 of their
    texts, and after the last comes the first. A null text is empty; a text
    without words has no hashes, is wholly like another such text and unlike
    all others. An empty table gives no rows.

    The order is cut into parts of about ``part_bytes`` of text (larger ones
    beyond ``most_parts``); only the keys of their first rows go to the driver.
    Every text moves once, to its part, and the first of a part also to the part
    before. A part is read in order, one text after the other. Rows equal in id
    and text share a part.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).cast("bigint").alias("doc_id"), F.md5(body).alias("tie"), body.alias("text"))
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = min(most_parts, max(1, math.ceil((size or 0) / part_bytes)))
    step = max(1, -(-rows // parts))
    slots = numbered(docs.select(F.lit(0).alias("all"), "doc_id", "tie"), "all", ["doc_id", "tie"])
    firsts = sorted({(r.doc_id is not None, r.doc_id or 0, r.tie)
                     for r in slots.where(F.col("slot") % step == 0).select("doc_id", "tie").collect()})
    if not firsts:
        return df.sparkSession.createDataFrame([], _COMPARED)

    @F.pandas_udf("array<int>")
    def parts_of(known: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for k, i, t in zip(known, ids, ties, strict=True):
            at = bisect.bisect_right(firsts, (bool(k), int(i), t)) - 1
            out.append([at, (at - 1) % len(firsts)] if firsts[at] == (bool(k), int(i), t) else [at])
        return pd.Series(out)

    sent = docs.withColumn("parts", parts_of(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("tie")))
    sent = sent.select("doc_id", "tie", "text", F.posexplode("parts").alias("after", "part"))
    arrow = to_arrow_schema(_COMPARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, doc_id and text of the row that waits for its next
        for batch in batches:
            out = []
            for doc_id, text, after, part in zip(*(batch.column(i) for i in range(4)), strict=True):
                after, part = after.as_py(), part.as_py()
                if after and (last is None or last[0] != part):
                    continue  # more rows equal to the first of the next part
                this = Hasher(text.as_py(), scale)
                if last is not None and last[0] == part:
                    out.append(_compared(last[1], last[2], this))
                last = None if after else (part, doc_id.as_py(), this)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    ordered = sent.repartitionById(len(firsts), F.col("part")).sortWithinPartitions("part", "after", "doc_id", "tie")
    return ordered.select("doc_id", "text", "after", "part").mapInArrow(run, _COMPARED)


def _compared(doc_id: int | None, this: Hasher, after: Hasher) -> dict:
    count = len(this.text)
    cut = count // 4
    head, tail = this.text[: count - cut], after.text[:cut]
    edited = this.edited(head, tail)
    return {"doc_id": doc_id, "n_chars": count, "edited_sha256": hashlib.sha256((head + tail).encode()).hexdigest(),
            "fingerprint": this.sketch.text(), "edited_fingerprint": edited.text(),
            "near_edited": likeness(this.sketch, edited), "near_next": likeness(this.sketch, after.sketch),
            "n_shingles": this.sketch.shingles}
