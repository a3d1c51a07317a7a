"""Byte-level BPE over whole texts, long ones in overlapping chunks, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

#: A pre-token that ends this close to the end of a chunk may end elsewhere in the whole text.
_UNSURE = 8


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """Encoding of a rank file (lines of a base64 token and its rank), without special tokens."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_CHUNK = StructType([
    StructField("row", LongType()), StructField("part", LongType()), StructField("start", LongType()),
    StructField("last", LongType()), StructField("body", StringType()),
])
_BOUNDS = StructType([*_CHUNK.fields, StructField("heads", ArrayType(LongType())),
                      StructField("tails", ArrayType(LongType()))])


def _with_key(key: StructField, schema: StructType) -> StructType:
    return StructType([StructField("doc_id", key.dataType), *schema.fields])


def _cut(schema: pa.Schema, chunk: int, overlap: int):
    """Overlapping chunks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                count = max(1, -(-(len(text) - overlap) // chunk))
                for low in range(0, count, 64):
                    yield pa.RecordBatch.from_pylist([
                        {"doc_id": doc.as_py(), "row": row.as_py(), "part": i, "start": i * chunk, "last": count - 1,
                         "body": text[i * chunk : i * chunk + chunk + overlap if i < count - 1 else None]}
                        for i in range(low, min(low + 64, count))
                    ], schema=schema)

    return run


def _pretokenise(schema: pa.Schema, pattern: str, chunk: int, overlap: int):
    """Starts of pre-tokens: those in the overlap with the chunk before (heads) and with the one after (tails)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                at, size = r["start"], len(r["body"])
                starts = [m.start() for m in find(r["body"])]
                r["heads"] = [at + s for s in starts if s < overlap] if r["part"] else []
                r["tails"] = [at + s for s in starts if chunk <= s <= size - _UNSURE] if r["part"] < r["last"] else []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def stitched(long: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Cut long texts (doc_id, row, body) at pre-token boundaries: doc_id, row, part, body.

    Chunks that overlap are pre-tokenised in tasks of their own. The pattern has
    no memory, so where the boundaries of two neighbours first coincide, both
    go on alike: the text is cut there. From neighbours that agree nowhere in
    their overlap (a pre-token longer than it) on, the rest of the text stays
    one part. Parts joined are always the whole text, and every cut is a
    boundary of the whole text.
    """
    chunk_schema = _with_key(long.schema["doc_id"], _CHUNK)
    bound_schema = _with_key(long.schema["doc_id"], _BOUNDS)
    chunks = long.select("doc_id", "row", "body").mapInArrow(
        _cut(to_arrow_schema(chunk_schema), chunk, overlap), chunk_schema)
    bounds = chunks.repartition(F.xxhash64("row", "part")).mapInArrow(
        _pretokenise(to_arrow_schema(bound_schema), pattern, chunk, overlap), bound_schema)
    order = Window.partitionBy("row").orderBy("part")
    common = F.array_min(F.array_intersect(F.lag("tails").over(order), F.col("heads")))
    cut = bounds.withColumn("cut", F.when(F.col("part") == 0, F.lit(0)).otherwise(common)).drop("heads", "tails")
    agreed = cut.withColumn("cut", F.when(F.min(F.col("cut").isNotNull()).over(order), F.col("cut")))
    spans = (
        agreed.withColumn("segment", F.count("cut").over(order))
        .withColumn("next", F.lead("cut").over(order))
        # A chunk's own text: from its cut, or else its start, up to the next chunk's cut or start.
        .withColumn("low", F.coalesce("cut", "start") - F.col("start"))
        .withColumn("high", F.when(F.col("part") == F.col("last"), F.length("body"))
                    .otherwise(F.coalesce("next", F.col("start") + chunk) - F.col("start")))
    )
    own = F.substring(F.col("body"), F.col("low").cast("int") + 1, (F.col("high") - F.col("low")).cast("int"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "own"))), lambda x: x["own"])
    return spans.select("doc_id", "row", "segment", "part", own.alias("own")).groupBy("row", "segment").agg(
        F.first("doc_id").alias("doc_id"), F.array_join(texts, "").alias("body")
    ).select("doc_id", "row", F.col("segment").alias("part"), "body")


#: What a text's ids become in the task that has them all: result columns and the function that makes them.
_AS_IDS = ([StructField("ids", BinaryType())], lambda _, ids: (ids,))
_AS_DIGESTS = (
    [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
     StructField("decoded_sha256", StringType())],
    lambda found, ids: _digest(found, np.frombuffer(ids, "<u4").tolist()),
)


def _digest(found: tiktoken.Encoding, ids: list[int]) -> tuple[int, str, str]:
    text = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return len(ids), text, hashlib.sha256(found.decode_bytes(ids)).hexdigest()


def _results(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _whole(schema: pa.Schema, path: str, pattern: str, finish):
    """Encode (.., body) and end each row with what ``finish`` makes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoding(path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                ids = (np.array(found.encode_ordinary(t.as_py()), "<u4").tobytes() for t in some.columns[-1])
                rows = zip(*[c.to_pylist() for c in some.columns[:-1]], ids, strict=True)
                yield _results([(*r[:-1], *finish(found, r[-1])) for r in rows], schema)

    return run


def _gather(schema: pa.Schema, path: str, pattern: str, finish):
    """Join the ids of consecutive parts (doc_id, row, part, ids) of the same row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoding(path, pattern)
        row, doc, held = None, None, []
        for batch in batches:
            for part in batch.to_pylist():
                if part["row"] != row and held:
                    yield _results([(doc, *finish(found, b"".join(held)))], schema)
                    held = []
                row, doc = part["row"], part["doc_id"]
                held.append(part["ids"])
        if held:
            yield _results([(doc, *finish(found, b"".join(held)))], schema)

    return run


def _encoded(df: DataFrame, path: str, pattern: str, key: str, text: str, chunk: int, overlap: int, form) -> DataFrame:
    if not 2 * _UNSURE < overlap < chunk:
        raise ValueError("the overlap must be longer than what is unsure and shorter than a chunk")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"),
                     F.coalesce(F.col(text), F.lit("")).alias("body"))
    is_long = F.length("body") > chunk + overlap
    fields, finish = form
    result = StructType([rows.schema["doc_id"], *fields])
    parted = StructType([rows.schema["doc_id"], StructField("row", LongType()), StructField("part", LongType()),
                         StructField("ids", BinaryType())])
    short = rows.where(~is_long).select("doc_id", "body").mapInArrow(
        _whole(to_arrow_schema(result), path, pattern, finish), result)
    parts = stitched(rows.where(is_long), pattern, chunk, overlap)
    pieces = parts.repartition(F.xxhash64("row", "part")).mapInArrow(
        _whole(to_arrow_schema(parted), path, pattern, _AS_IDS[1]), parted)
    long = pieces.repartition("row").sortWithinPartitions("row", "part").mapInArrow(
        _gather(to_arrow_schema(result), path, pattern, finish), result)
    return short.unionByName(long)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
           chunk: int = 32_768, overlap: int = 2_048) -> DataFrame:
    """Ids of every whole text: doc_id and ids (binary, little-endian unsigned 32-bit).

    Texts of up to ``chunk + overlap`` characters are one chunk and stay in their
    task. Longer ones are cut by ``stitched`` and their parts encoded side by
    side; only the ids of such texts are gathered again, per text. Null and empty
    texts have no ids. Rows that repeat, or whose key is null, give a row each.
    """
    return _encoded(df, path, pattern, key, text, chunk, overlap, _AS_IDS)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
            chunk: int = 32_768, overlap: int = 2_048) -> DataFrame:
    """Encode every whole text and decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    As ``encode``; the digests are made in the task that has all ids of a text.
    """
    return _encoded(df, path, pattern, key, text, chunk, overlap, _AS_DIGESTS)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Raw bytes of ids: doc_id and decoded (binary), the bytes of the tokens end to end.

    Null ids give null, ids of no token no bytes; an empty table gives no rows.
    """
    schema = StructType([encoded.schema["doc_id"], StructField("decoded", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = encoding(path, pattern).decode_bytes
        for batch in batches:
            out = [None if x is None else raw(np.frombuffer(x, "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
