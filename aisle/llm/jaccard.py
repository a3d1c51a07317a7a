"""Set similarity join of documents by their word n-grams, with a token-group matrix."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from aisle.llm.components import components
from aisle.llm.spans import Spans, mixed, slices, texts_of
from aisle.session import checkpointed, scratch_path

_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_RUN = 3  # consecutive tokens of a column of the matrix
_SMALL = 16  # sets up to this size have each token as a column too


def token_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams; with fewer words, of the whole sequence."""
    spans = Spans(texts, lower=True)
    starts, ends, doc = spans.words()
    hashes = spans.hashes(starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled = mixed(rolled * _STEP[1] + hashes[k : k + len(rolled)] + _STEP[0])
    out = []
    for n, at in zip(count.tolist(), first.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            # Marked with its length, so that it equals no n-gram.
            whole = np.full(1, n, np.uint64)
            for k in range(n):
                whole = mixed(whole * _STEP[2] + hashes[at + k : at + k + 1] + _STEP[3])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def windows_needed(threshold: float, miss: float = 1e-12) -> int:
    """Windows of the smallest tokens so that a linked pair shares none with a chance of ``miss`` at most.

    Along the union of two sets in hash order, a token is common with the
    threshold's probability at least. The chance of no three common ones in a
    row falls by a constant factor with each token; the factor is the root of
    the recurrence.
    """
    own = [1.0, 1.0, 1.0]
    n = 3
    while own[-1] > miss and n < 4_000:
        own.append((1 - threshold) * (own[-1] + threshold * own[-2] + threshold**2 * own[-3]))
        n += 1
    return n


def columns_of(tokens: np.ndarray, limit: int) -> np.ndarray:
    """Columns of the matrix in which a set has an entry: runs of its smallest tokens, and all tokens of a small set."""
    head = tokens[: limit + _RUN - 1]
    out = np.zeros(max(0, len(head) - _RUN + 1), np.uint64)
    for k in range(_RUN):
        out = mixed(out * _STEP[2] + head[k : k + len(out)] + _STEP[1])
    return np.concatenate([out, mixed(tokens ^ _STEP[3])]) if len(tokens) <= _SMALL else out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, for sorted sets."""
    total = len(a) + len(b)
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (total - common)


_SETS = StructType([*[StructField(c, LongType()) for c in ("row", "doc_id", "n", "digest", "other")],
                    StructField("columns", ArrayType(LongType()))])
_TOKENS = StructType([StructField("id", LongType()), StructField("tokens", BinaryType())])


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    if not len(tokens):
        return 0, 0
    return tuple(np.array([tokens.sum(), mixed(tokens ^ _STEP[0]).sum()], np.uint64).view(np.int64).tolist())


def _sets(docs: DataFrame, words: int, limit: int) -> DataFrame:
    """Set size, digest and matrix columns of every row (row, doc_id, text)."""
    schema = to_arrow_schema(_SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for low, high in slices([len(t) for t in texts], 500_000):
                sets = token_sets(texts[low:high], words)
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i)[low:high] for i in (0, 1)], pa.array([len(s) for s in sets], pa.int64()),
                    *[pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)],
                    pa.array([columns_of(s, limit).view(np.int64) for s in sets], pa.list_(pa.int64()))],
                    schema=schema)

    return docs.select("row", "doc_id", "text").mapInArrow(run, _SETS)


def _tokens(docs: DataFrame, words: int) -> DataFrame:
    """Tokens of classes (id, digest, other, text); a text that is not the class's own gives none."""
    schema = to_arrow_schema(_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(3))
            for low, high in slices([len(t) for t in texts], 500_000):
                keys = zip(*[batch.column(i)[low:high].to_pylist() for i in range(3)], strict=True)
                found = [(k[0], s.tobytes()) for k, s in zip(keys, token_sets(texts[low:high], words), strict=True)
                         if _digest(s) == k[1:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())],
                    schema=schema)

    return docs.select("id", "digest", "other", "text").mapInArrow(run, _TOKENS)


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar."""
    schema = to_arrow_schema(pairs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                    for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            hit = pa.array([similar(x, y, percent) for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns[:2]], schema=schema)

    one = tokens.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    two = tokens.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, pairs.schema)


_STORE = StructType([
    StructField("block", LongType()), StructField("ids", ArrayType(LongType())), StructField("groups", ArrayType(LongType())),
    StructField("sizes", ArrayType(LongType())), StructField("union", BinaryType()), StructField("places", BinaryType())])
_LINK = StructType([StructField("a", LongType()), StructField("b", LongType())])


def _store(members: DataFrame) -> DataFrame:
    """Blocks with the union of their tokens, and each set as places in the union (members: block, id, group, tokens)."""
    schema = to_arrow_schema(_STORE)

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        union, places = np.unique(np.concatenate(sets), return_inverse=True)
        return pa.Table.from_pylist([{
            "block": table.column("block")[0].as_py(), "ids": table.column("id").to_pylist(),
            "groups": table.column("group").to_pylist(), "sizes": [len(x) for x in sets], "union": union.tobytes(),
            "places": places.astype(np.uint32).tobytes()}], schema=schema)

    return members.groupBy("block").applyInArrow(run, _STORE)


class Block:
    """A stored block: ids and groups of its sets, their sizes, the token union, each set's places in the union."""

    def __init__(self, ids: list[int], groups: list[int], sizes: list[int], union: bytes, places: bytes):
        self.ids, self.groups, self.sizes = ids, np.array(groups, np.int64), np.array(sizes, np.int64)
        self.union, self.places = np.frombuffer(union, np.uint64), np.frombuffer(places, np.uint32)
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)

    def opened(self, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that hold enough of the ``common`` places of the union, and their rows over these."""
        column = np.full(len(self.union), -1, np.int64)
        column[common] = np.arange(len(common))
        at = column[self.places]
        held = np.bincount(self.owner[at >= 0], minlength=len(self.ids))
        few = np.flatnonzero(100 * held >= percent * self.sizes)
        row = np.full(len(self.ids), -1, np.int64)
        row[few] = np.arange(len(few))
        inside = (at >= 0) & (row[self.owner] >= 0)
        matrix = np.zeros((len(few), len(common)), np.float32)
        matrix[row[self.owner[inside]], at[inside]] = 1
        return few, matrix


def links_between(a: Block, b: Block, percent: int) -> list[tuple[int, int]]:
    """Similar pairs of two blocks (or of one with itself) that join different groups; no link that others imply.

    Whatever set y of the other block, |x & y| <= |x & union| and |x | y| >= |x|:
    only sets whose overlap with the other union is large enough are opened.
    """
    _, in_a, in_b = np.intersect1d(a.union, b.union, assume_unique=True, return_indices=True)
    few_a, rows_a = a.opened(in_a, percent)
    few_b, rows_b = b.opened(in_b, percent)
    if not len(few_a) or not len(few_b):
        return []
    shared = (rows_a @ rows_b.T).astype(np.int64)
    total = a.sizes[few_a][:, None] + b.sizes[few_b][None, :] - shared
    hits = (100 * shared >= percent * total) & (a.groups[few_a][:, None] != b.groups[few_b][None, :])
    root: dict[int, int] = {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            root[g] = root.get(root[g], root[g])
            g = root[g]
        return g

    links = []
    for i, j in zip(*(few[x].tolist() for few, x in zip((few_a, few_b), np.nonzero(hits), strict=True)), strict=True):
        one, two = find(int(a.groups[i])), find(int(b.groups[j]))
        if one != two:
            root[one] = two
            links.append((a.ids[i], b.ids[j]))
    return links


def _opened(asked: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of pairs of blocks."""
    schema = to_arrow_schema(_LINK)
    fields = _STORE.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (Block(*(x.as_py() for x in [c[i] for c in batch.columns[at : at + len(fields)]]))
                            for at in (0, len(fields)))
                links = links_between(one, two, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())],
                    schema=schema)

    return asked.select(*fields, *[f"{c}2" for c in fields]).mapInArrow(run, _LINK)


def similar_documents(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                      block: int = 128, rounds: int = 1, room: int = 1 << 16) -> DataFrame:
    """Classes of documents whose sets of word n-grams are similar: doc_id, n_shingles, component_id.

    A text's words (A-Z in lower case) are what lies between blanks. Its set has
    the distinct n-grams of ``words`` words, or the whole sequence if it has
    fewer; without words the set is empty and links with nothing. Two documents
    link when 100 * |intersection| >= percent * |union|. component_id is the
    smallest doc_id reachable by links, itself included. Every row of ``df``
    gives a row; rows with equal doc_id may have different texts. A row with a
    null doc_id links with nothing and has a null component.

    1. Documents with equal sets are one class; from here on only classes move.
    2. The matrix has a column for each run of three neighbouring tokens, in hash
       order, among the smallest of a set; ``windows_needed`` says how many leave
       a chance under 10**-12 to miss a linked pair (all runs of a short set are
       there, which leaves none). Only columns with two sets or more remain.
    3. Partition: in each column one class leads, and classes that are really
       similar to a leader form a group with it. This goes on for ``rounds``
       rounds with other leaders, in the columns that still hold several groups;
       only classes that are not in the leader's group are compared.
    4. What still shares a column with another group is dealt to blocks: a large
       group has its own, the rest goes by its hottest column and its size. A
       block has about ``block`` sets and ``room`` tokens, or one longer set. It
       stores the union of its tokens and each set as places in the union.
       Blocks meet if they share a column, sizes that fit, and several groups.
    5. The union of one block bounds the overlap of each set of the other with
       any of its sets; only sets that qualify are opened and compared, with one
       product of two 0/1 matrices.
    Links found in 3 and 5 make the components. A hot column costs one row per
    class in each round of step 3. Step 4 pairs blocks, not classes: c classes
    of different groups in one column make (c / block)**2 / 2 rows at best.
    """
    spark = df.sparkSession

    def written(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("doc_id"),
                     F.col(text).alias("text"))
    sets = written(_sets(docs, words, windows_needed(percent / 100)), "sets")
    same = ["n", "digest", "other"]
    classes = checkpointed(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy(*same).agg(
        F.min("row").alias("id"), F.min_by("doc_id", "row").alias("holder"), F.min("doc_id").alias("lowest")))

    entries = sets.join(classes.select(F.col("id").alias("row")), "row", "left_semi").select(
        F.col("row").alias("id"), "n", F.explode("columns").alias("column"))
    shared = entries.groupBy("column").agg(F.count("*").alias("sets"), F.min("id").alias("leader")).where("sets > 1")
    matrix = written(entries.join(shared, "column").select("column", "id", "n", "leader"), "matrix")
    touched = classes.join(matrix.select("id").distinct(), "id", "left_semi")
    # Bucketed by class, so that looking up a few pairs does not move all sets again.
    name = f"token_sets_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _tokens(
        docs.join(touched.select("id", "digest", "other", F.col("holder").alias("doc_id")), "doc_id"), words)
    found.repartition(buckets, "id").dropDuplicates(["id"]).write.bucketBy(buckets, "id").sortBy("id").saveAsTable(name)
    tokens = spark.table(name)
    links, cells = _grouped(matrix, tokens, percent, rounds, written)
    second = _across_groups(cells, tokens, percent, block, room, written)
    spark.sql(f"DROP TABLE {name}")
    roots = checkpointed(components(links.unionByName(second)))
    labelled = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select(
        *same, "lowest", F.coalesce("component", "id").alias("root"))
    names = labelled.groupBy("root").agg(F.min("lowest").alias("component_id"))
    named = labelled.join(names, "root").select(*same, "component_id")
    # Sets without tokens or id are in no class.
    return sets.select("doc_id", F.col("n").alias("n_shingles"), *same).join(
        named, same, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _fits(small: str, large: str, percent: int):
    """Whether sets of two sizes can be similar."""
    return F.col(large) * 100 >= F.col(small) * percent


def _grouped(matrix: DataFrame, tokens: DataFrame, percent: int, rounds: int, written) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) to leaders, and the cells (column, id, n, group, sets) of columns that hold several groups."""
    led = matrix.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    links = checkpointed(_verified(led, tokens, percent))
    cells = matrix.select("column", "id", "n")
    for number in range(1, rounds + 1):
        groups = components(links).select(F.col("node").alias("id"), F.col("component").alias("group"))
        cells = cells.select("column", "id", "n").join(groups, "id", "left").withColumn(
            "group", F.coalesce("group", "id"))
        crossing = cells.groupBy("column").agg(
            F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("sets")).where("low < high")
        cells = written(cells.join(crossing.select("column", "sets"), "column"), f"cells{number}")
        if number == rounds:
            break
        # Four orders a round: a class that is in many columns meets several leaders.
        rank = F.xxhash64("id", F.pmod(F.col("column"), F.lit(4)), F.lit(number))
        leaders = cells.groupBy("column").agg(F.min_by(F.struct("id", "n", "group"), F.struct(rank, "id")).alias("top"))
        led = cells.join(leaders, "column").where(
            (F.col("group") != F.col("top.group"))
            & (100 * F.least("n", "top.n") >= percent * F.greatest("n", "top.n"))
        ).select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b")).distinct()
        links = checkpointed(links.unionByName(_verified(led, tokens, percent)))
    return links, cells


def _across_groups(cells: DataFrame, tokens: DataFrame, percent: int, block: int, room: int, written) -> DataFrame:
    """Links (a, b) between classes of different groups, through the unions of blocks."""
    classes = cells.groupBy("id").agg(
        F.first("n").alias("n"), F.first("group").alias("group"),
        F.max_by("column", F.struct("sets", "column")).alias("column"))
    counts = classes.groupBy("group").agg(F.count("*").alias("members"))
    step = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")
    homes = checkpointed(classes.join(counts, "group").select(
        "id", "n", "group", F.when(F.col("members") >= block, F.xxhash64(F.lit(0), "group")).otherwise(
            F.xxhash64(F.lit(1), "column", step)).alias("home")))
    sizes = homes.groupBy("home").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / room)).alias("blocks"))
    members = checkpointed(homes.join(sizes, "home").select(
        "id", "group", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("block")))
    held = checkpointed(cells.select("column", "id", "n").join(members, "id").groupBy("column", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("group").alias("low"), F.max("group").alias("high")))
    others = held.select("column", *[F.col(c).alias(f"{c}2") for c in held.columns[1:]])
    meets = checkpointed(held.join(others, "column").where(
        (F.col("block") <= F.col("block2")) & _fits("least", "most2", percent) & _fits("least2", "most", percent)
        & (F.least("low", "low2") < F.greatest("high", "high2"))).select("block", "block2").distinct())
    needed = meets.select("block").union(meets.select("block2")).distinct()
    store = written(_store(members.join(needed, "block", "left_semi").join(tokens, "id")), "blocks")
    asked = meets.join(store, "block").join(store.toDF(*[f"{c}2" for c in store.columns]), "block2")
    return checkpointed(_opened(asked, percent))
