"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.session import checkpointed


def draw(key: Column, shard: int) -> Column:
    """Uniform number in (0, 1) for a key and a shard, from 52 bits of an MD5.

    A null key draws as the text ``null``; equal keys always draw alike.
    """
    text = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard with the highest score ``weight / -ln(draw)`` for the key.

    A shard wins a share of the keys that is proportional to its weight. One
    more shard takes keys from the others into itself and moves no other; the
    scores of the shards that were there do not change. Ties go to the lower
    shard. Shards of weight 0 get nothing.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [
        F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("score"), F.lit(-i).alias("shard"))
        for i, w in enumerate(weights) if w > 0
    ]
    best = F.array_max(F.array(*scores))
    return (-best["shard"]).cast("int")


def numbered(df: DataFrame, shard: str, order: Sequence[str], name: str = "slot") -> DataFrame:
    """Gapless place of each row inside its shard, from 0, along ``order``.

    Rows are range-partitioned by shard and order, so a shard spans many tasks;
    rows that are equal in all of ``order`` are told apart by a running id and
    may be cut between tasks as well. Each slice is numbered on its own and
    shifted by the counts of the slices before it (one count per slice and
    shard). Null order values come first.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(slices, shard, *order, "_tie")
        .withColumn("_slice", F.spark_partition_id())
    )
    counts = cut.groupBy(shard, "_slice").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(shard, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_slice", shard).orderBy(*order, "_tie")
    placed = cut.withColumn("_no", F.row_number().over(inside))
    return placed.join(shifts, [shard, "_slice"]).select(
        *df.columns, (F.col("_before") + F.col("_no") - 1).alias(name))


def shard_documents(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                    weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: key, size, checksum of the text, shard, slot and the shard if there were one more.

    The key and the shards decide alone (law ``key``); the added shard has the
    mean weight. Size is the bytes of the text plus 8; a null text has none and
    the checksum of an empty one. Rows with the same key share a shard and get
    slots of their own. An empty table gives no rows.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    grown = [*weights, sum(weights) / shards]
    body = F.coalesce(F.col(text), F.lit(""))
    placed = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id",
                 weights: Sequence[float] | None = None) -> None:
    """Write the rows of ``df`` to one folder per shard, all columns kept.

    Folders are named by a column ``shard``; where ``df`` has that name already,
    by the first of ``shard_``, ``shard__`` and so on that is free. An empty table
    writes no folder.
    """
    weights = list(weights or [1.0] * shards)
    name, taken = "shard", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    df.withColumn(name, rendezvous(F.col(key), weights)).write.mode("overwrite").partitionBy(name).parquet(path)
