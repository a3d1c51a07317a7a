"""Hard negatives: rows of other labels whose score lies just below that of an anchor's positives.

Rows are dealt into blocks of one label, near the same centre; each block is a
cover tree of its own (``cover_tree``), stored as one row. Anchors travel in
groups. A block goes only to the groups for which its root's ball can hold a
score that counts, and the task of a group descends the trees best-first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from aisle.llm.cover_tree import Best, Block, CoverTree, augmented, search
from aisle.llm.sharding import numbered
from aisle.session import scratch_path


def quantised(df: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
              label: str = "label") -> DataFrame:
    """vec_id, label and the vector of integers ``floor(scale * x)``; only rows that take part.

    A null label, key or vector, and any null or non-finite component, leave a
    row out. Components whose product with the scale no long can hold become the
    largest or smallest long.
    """
    rows = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
                     F.col(vector).cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound).select(
        "vec_id", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("bigint")).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Integer rows of a list column, with zeros after the end of shorter ones."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < lengths[:, None]] = flat
    return out


def _packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest form that holds them; the first byte is its width."""
    most = int(max(-(x.min(initial=0) + 1), x.max(initial=0)))
    kind = next(k for k in (np.int16, np.int32, np.int64) if most <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(x, kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


_BLOCK = StructType([
    StructField("label", LongType()), StructField("ids", BinaryType()), StructField("v", BinaryType()),
    StructField("nodes", BinaryType()), StructField("radius", BinaryType())])


def _stored(block: Block) -> dict:
    t = block.tree
    return {"label": block.label, "ids": _packed(block.ids), "v": _packed(block.v.ravel()),
            "nodes": _packed(np.concatenate([t.centre, t.low, t.own, t.child, t.child_end])),
            "radius": t.radius.tobytes()}


def _loaded(row: dict, dims: int) -> Block:
    nodes, ids = _unpacked(row["nodes"]).reshape(5, -1), _unpacked(row["ids"])
    tree = CoverTree(np.arange(len(ids)), nodes[0], np.frombuffer(row["radius"]), *nodes[1:])
    return Block(row["label"], ids, _unpacked(row["v"]).reshape(-1, dims), tree)


def _centres(rows: DataFrame, count: int, sample: int, dims: int, most: float) -> np.ndarray:
    """Centres of the top level: rows of a bounded sample (lowest hashes), each the farthest from those before."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v").toArrow().sort_by("vec_id")
    x = augmented(_matrix(some.column("v").combine_chunks(), dims).astype(float), most)
    picked = [0]
    away = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(count, len(x)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def placed(rows: DataFrame, centres: np.ndarray, dims: int, most: float) -> DataFrame:
    """Rows (vec_id, label, v) with the number of their nearest centre of the top level, in column ``cell``."""
    half = (centres**2).sum(axis=1) / 2
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = augmented(_matrix(batch.column(2), dims).astype(float), most)
                cell = (half[None, :] - x @ centres.T).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], schema=arrow)

    return rows.mapInArrow(run, schema)


def build_index(rows: DataFrame, dims: int, most: float, block_rows: int = 2_048) -> DataFrame:
    """Stored blocks: label and a cover tree of at most ``block_rows`` rows of that label, one block a row.

    ``rows`` are placed. The rows of a label and centre are numbered and cut, so
    neither a frequent label nor a crowded centre meets in one task.
    """
    dealt = numbered(
        rows.select(F.struct("label", "cell").alias("cell"), F.xxhash64("vec_id").alias("mix"), "vec_id", "v"),
        "cell", ["mix", "vec_id"]).withColumn("part", F.floor(F.col("slot") / block_rows))
    schema = to_arrow_schema(_BLOCK)

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        v = _matrix(table.column("v").combine_chunks(), dims)
        tree = CoverTree.build(augmented(v.astype(float), most))
        ids = table.column("vec_id").to_numpy()
        block = Block(table.column("cell")[0].as_py()["label"], ids[tree.order], v[tree.order], tree)
        return pa.Table.from_pylist([_stored(block)], schema=schema)

    return dealt.select("cell", "part", "vec_id", "v").groupBy("cell", "part").applyInArrow(grow, _BLOCK)


_GROUP = StructType([
    StructField("group", LongType()), StructField("ids", BinaryType()), StructField("labels", BinaryType()),
    StructField("v", BinaryType()), StructField("owner", BinaryType()), StructField("positive", BinaryType()),
    StructField("score", BinaryType())])


def _groups(anchors: DataFrame, dims: int) -> DataFrame:
    """Anchors (group, vec_id, label, v, positives) of a group as one row; a window for each positive."""
    schema = to_arrow_schema(_GROUP)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        asked = table.column("positives").to_pylist()
        flat = [p for some in asked for p in some]
        return pa.Table.from_pylist([{
            "group": table.column("group")[0].as_py(), "ids": _packed(table.column("vec_id").to_numpy()),
            "labels": _packed(table.column("label").to_numpy()),
            "v": _packed(_matrix(table.column("v").combine_chunks(), dims).ravel()),
            "owner": _packed(np.repeat(np.arange(len(asked)), [len(some) for some in asked])),
            "positive": _packed(np.array([p["id"] for p in flat], np.int64)),
            "score": _packed(np.array([p["score"] for p in flat], np.int64))}], schema=schema)

    return anchors.groupBy("group").applyInArrow(pack, _GROUP)


_FOUND = StructType([
    StructField("anchor_id", LongType()), StructField("positive_id", LongType()), StructField("positive_score", LongType()),
    StructField("id", LongType()), StructField("score", LongType())])


def _searched(blocks: DataFrame, groups: DataFrame, dims: int, most: float, k: int,
              percent: tuple[int, int] | None, together: int = 32) -> DataFrame:
    """The first k rows of each window of each anchor, from each part of the blocks that a task met.

    Without ``percent`` the rows of an anchor's own label count, whatever their
    score, and an anchor has one window. With it, rows of other labels count
    whose score lies in the window of a positive. Groups are described to all
    tasks by a ball and a range of labels and scores (there are at most some
    16,000). A block is sent to the groups that it can have rows for. A task
    holds one group and ``together`` blocks at a time.
    """
    spark = blocks.sparkSession
    described = []

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v, labels = _unpacked(row["v"]).reshape(-1, dims).astype(float), _unpacked(row["labels"])
                score = _unpacked(row["score"])
                middle = v.mean(axis=0)
                low = percent[0] * float(score.min(initial=2**62)) / 100 if percent else -np.inf
                high = percent[1] * float(score.max(initial=-(2**62))) / 100 if percent else np.inf
                far = np.linalg.norm(v - middle, axis=1).max()
                yield pa.RecordBatch.from_pylist([{
                    "group": row["group"], "low_label": int(labels.min()), "high_label": int(labels.max()),
                    "numbers": np.array([low, high, far, *middle]).tobytes()}])

    for row in groups.mapInArrow(describe, "group long, low_label long, high_label long, numbers binary").collect():
        described.append((row.group, row.low_label, row.high_label, np.frombuffer(row.numbers)))
    if not described:
        return spark.createDataFrame([], _FOUND)
    described.sort(key=lambda d: d[0])
    number, low_label, high_label = (np.array([d[i] for d in described], np.int64) for i in range(3))
    numbers = np.array([d[3] for d in described])
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(1, -(-tasks // len(described))), max(1, blocks.count()))
    sent_schema = StructType([StructField("group", LongType()), StructField("part", IntegerType()), *_BLOCK.fields])
    arrow = to_arrow_schema(sent_schema)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, far, middle = numbers[:, 0], numbers[:, 1], numbers[:, 2], numbers[:, 3:]
        size = np.linalg.norm(middle, axis=1)
        for batch in batches:
            for row in batch.to_pylist():
                block = _loaded(row, dims)
                centre, r = block.v[block.tree.centre[0]].astype(float), block.tree.radius[0]
                near, norm = middle @ centre, np.linalg.norm(centre)
                reach = size * r + far * norm + far * r + 1e-6 + 1e-9 * (size + far + norm + r) ** 2
                if percent is None:
                    wanted = (low_label <= block.label) & (block.label <= high_label)
                else:
                    wanted = (low_label != block.label) | (high_label != block.label)
                    wanted &= (near + reach >= low) & (near - reach <= high)
                part = int(block.ids[0]) % parts
                rows = [{"group": int(g), "part": part, **row} for g in number[wanted]]
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=arrow)

    sent = blocks.mapInArrow(route, sent_schema)
    asked = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "v", "nodes", "radius")]
    both = sent.select("group", "part", F.lit(1).alias("kind"), "label", "ids", "v", "nodes", "radius",
                       F.lit(None).cast(_GROUP).alias("asked")).unionByName(
        asked.select("group", "part", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("label"), *none,
                     F.struct(*_GROUP.names).alias("asked")))
    found = to_arrow_schema(_FOUND)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, []

        def work() -> None:
            if state is not None and held:
                same = [state["labels"] == b.label for b in held]
                asks = same if percent is None else [~s for s in same]
                search(held, state["v"], asks, state["owner"], state["best"], state["ids"], most)
            held.clear()

        def result() -> Iterator[pa.RecordBatch]:
            if state is not None and len(w := state["best"].window):
                yield pa.RecordBatch.from_arrays([
                    pa.array(state["ids"][state["owner"][w]]), pa.array(state["positive"][w]),
                    pa.array(state["score"][w]), pa.array(state["best"].id), pa.array(state["best"].score)],
                    schema=found)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["kind"] == 0:
                    work()
                    yield from result()
                    a = row["asked"]
                    state = {c: _unpacked(a[c]) for c in ("ids", "labels", "owner", "positive", "score")}
                    state["v"] = _unpacked(a["v"]).reshape(-1, dims)
                    state["best"] = Best(state["score"], state["score"], percent, k) if percent else Best(None, None, None, k)
                else:
                    held.append(_loaded(row, dims))
                    if len(held) == together:
                        work()
        work()
        yield from result()

    return both.repartition("group", "part").sortWithinPartitions("group", "part", "kind").mapInArrow(descend, _FOUND)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5,
                   percent: tuple[int, int] = (80, 100), block_rows: int = 2_048, group_rows: int = 512,
                   sample: int = 20_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and v (integers, as ``quantised`` gives them);
    ``anchor`` says which rows are anchors. Scores are integer inner products; a
    shorter vector counts as ending in zeros. Higher scores come first, ties by
    the smaller vec_id. An anchor's positives are its first other rows of the same
    label; for each of them the first rows of another label with
    ``percent[0] * positive_score <= 100 * negative_score <= percent[1] * positive_score``
    are returned. An anchor without positives or negatives gives no rows. Of rows
    that repeat a vec_id one takes part (smallest label, then vector); null keys,
    labels and vectors take none. Other columns are not read. An OverflowError is
    raised if a hundred times a score could pass a long.

    Every row goes to the nearest centre of the top level, which is fitted on at
    most ``sample`` rows (lowest hashes of their ids) and has at most 1,024 centres.
    All pairs of anchors and rows that no bound excludes are scored, so with
    vectors that form no clusters the work grows with their product; it is dealt
    by groups of anchors and parts of the blocks, and no task holds more than one
    group and some blocks.
    """
    spark = rows.sparkSession
    once = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(
        F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    once.write.parquet(where := scratch_path(spark, "vectors"))
    rows = spark.read.schema(once.schema).parquet(where)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dims, most = rows.agg(F.max(F.size("v")), F.max(norm)).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return spark.createDataFrame([], out)
    largest = rows.groupBy("label").count().agg(F.max("count")).first()[0]
    centres = _centres(rows, min(1_024, -(-largest // block_rows)), sample, dims, most)
    rows = placed(rows, centres, dims, most)
    build_index(rows, dims, most, block_rows).write.parquet(where := scratch_path(spark, "blocks"))
    blocks = spark.read.schema(_BLOCK).parquet(where)

    first = rows.where(anchor)
    size = max(group_rows, -(-first.count() // 16_384))
    # The anchors of a group are near each other, so a block can be of no use to all of them.
    order = numbered(first.withColumn("_all", F.lit(0)), "_all", ["label", "cell", "vec_id"]).withColumn(
        "group", F.floor(F.col("slot") / size)).select("group", "vec_id", "label", "v")
    order.write.parquet(where := scratch_path(spark, "anchors"))
    anchors = spark.read.schema(order.schema).parquet(where)

    one = F.array(F.struct(F.lit(-1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("score")))
    near = _searched(blocks, _groups(anchors.withColumn("positives", one), dims), dims, most, positives, None)
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = near.withColumn("_no", F.row_number().over(by_score)).where(F.col("_no") <= positives)
    asked = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct("id", "score"))).alias("positives"))
    _groups(anchors.join(asked, "vec_id"), dims).write.parquet(where := scratch_path(spark, "asked"))
    found = _searched(blocks, spark.read.schema(_GROUP).parquet(where), dims, most, negatives, percent)
    by_score = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
