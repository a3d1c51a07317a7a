"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from aisle.llm.components import components
from aisle.session import checkpointed, stored


@dataclass
class Forest:
    """Trees of random directions; node ``i`` of a tree splits into ``2 i + 1`` and ``2 i + 2``.

    A vector goes to both sides of a split if its projection is within ``spill``
    of the cut, so it can have several leaves in each tree.
    """

    directions: np.ndarray  # trees x nodes x dimensions
    cuts: np.ndarray  # trees x nodes
    depth: int
    spill: float

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, spill: float, seed: int = 11) -> Forest:
        draw = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        directions = draw.normal(size=(trees, nodes, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        cuts = np.zeros((trees, nodes))
        for t in range(trees):
            held = [sample] + [None] * (2 * nodes)
            for node in range(nodes):
                rows = held[node]
                if not len(rows):
                    rows = np.zeros((1, sample.shape[1]))
                along = rows @ directions[t, node]
                cuts[t, node] = np.median(along)
                held[2 * node + 1], held[2 * node + 2] = rows[along <= cuts[t, node]], rows[along > cuts[t, node]]
        return cls(directions, cuts, depth, spill)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf number (unique over all trees) of every place of every vector."""
        rows, out = [], []
        width = 1 << self.depth
        for t in range(len(self.cuts)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", x[row], self.directions[t][node]) - self.cuts[t][node]
                left, right = along <= self.spill, along > -self.spill
                row, node = (np.concatenate([row[left], row[right]]),
                             np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]))
            rows.append(row)
            out.append(t * width + node - (width - 1))
        return np.concatenate(rows), np.concatenate(out)


class Subtree:
    """A tree below a large leaf, fitted on some of its own rows.

    A node where half of these rows would go both ways has no cut (NaN) and
    stays a leaf: near copies without end are not copied at every level.
    """

    def __init__(self, cuts: np.ndarray, dimensions: int, spill: float, seed: int):
        directions = np.random.default_rng(seed).normal(size=(len(cuts), dimensions))
        self.directions = directions / np.linalg.norm(directions, axis=1, keepdims=True)
        self.cuts, self.spill = cuts, spill

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, spill: float, seed: int) -> Subtree:
        tree = cls(np.full((1 << depth) - 1, np.nan), sample.shape[1], spill, seed)
        held = {0: sample}
        for node in range(len(tree.cuts)):
            rows = held.pop(node, None)
            if rows is None or len(rows) < 8:
                continue
            along = rows @ tree.directions[node]
            cut = np.median(along)
            if (np.abs(along - cut) <= spill).mean() < 0.5:
                tree.cuts[node] = cut
                held[2 * node + 1], held[2 * node + 2] = rows[along <= cut], rows[along > cut]
        return tree

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and node of every place of every vector."""
        row, node, rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64), [], []
        while len(row):
            cut = np.where(node < len(self.cuts), self.cuts[np.minimum(node, len(self.cuts) - 1)], np.nan)
            still = np.isnan(cut)
            rows.append(row[still])
            nodes.append(node[still])
            row, node, cut = row[~still], node[~still], cut[~still]
            along = np.einsum("ij,ij->i", x[row], self.directions[node]) - cut
            left, right = along <= self.spill, along > -self.spill
            row, node = (np.concatenate([row[left], row[right]]),
                         np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]))
        return np.concatenate(rows), np.concatenate(nodes)


_PLACED = StructType([
    StructField("id", LongType()), StructField("label", StringType()), StructField("weight", LongType()),
    StructField("v", BinaryType()), StructField("leaves", ArrayType(LongType()))])
_FOUND = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("n", LongType())])


def _shared_before(mine: list[np.ndarray], others: list[np.ndarray], leaf: int) -> np.ndarray:
    """Whether two vectors share a leaf with a lower number, for all pairs of two blocks."""
    earlier = [[x[x < leaf] for x in side] for side in (mine, others)]
    known = np.unique(np.concatenate([*earlier[0], np.zeros(0, np.int64)]))
    held = []
    for side in earlier:
        m = np.zeros((len(side), len(known)), np.float32)
        for i, x in enumerate(side):
            at = np.searchsorted(known, x)
            ok = at < len(known)
            at, x = at[ok], x[ok]
            m[i, at[known[at] == x]] = 1
        held.append(m)
    return (held[0] @ held[1].T) > 0


def _cell(least: float, dimensions: int):
    """Links inside a cell (one block of a leaf, or two): counts for each vector, and enough links to join them."""
    schema = to_arrow_schema(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        block = table.column("block").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), float).reshape(-1, dimensions)
        leaves = [np.array(y) for y in table.column("leaves").to_pylist()]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        close = x[left] @ x[right].T >= least
        if one == two:
            close = np.triu(close, 1)
        some = close.any(axis=1)
        left, close = left[some], close[some]
        if len(left):
            close &= ~_shared_before([leaves[i] for i in left], [leaves[i] for i in right], leaf)
        counts = np.zeros(len(ids), np.int64)
        counts[left] += close @ weight[right]
        counts[right] += weight[left] @ close
        # A spanning forest of the links found: each row's first link, and one from each column to its first row.
        i, j = np.nonzero(close)
        keep = np.zeros(len(i), bool)
        keep[np.unique(i, return_index=True)[1]] = True
        keep[np.unique(j, return_index=True)[1]] = True
        # Rows and columns that these leave apart are joined by what is left over between them.
        i, j = left[i], right[j]
        root = np.arange(len(ids))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        edges = []
        for a, b in [*zip(i[keep], j[keep], strict=True)]:
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
                edges.append((a, b))
        while len(i):
            for k in range(len(root)):
                root[k] = find(k)
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            pairs = np.unique(np.stack([root[i], root[j]]), axis=1, return_index=True)[1] if len(i) else []
            for a, b in [(i[k], j[k]) for k in pairs]:
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    edges.append((a, b))
        counted = np.flatnonzero(counts)
        return pa.Table.from_arrays([
            pa.array(np.concatenate([ids[counted], ids[[a for a, _ in edges]]]).astype(np.int64)),
            pa.array([None] * len(counted) + ids[[b for _, b in edges]].tolist(), pa.int64()),
            pa.array(counts[counted].tolist() + [None] * len(edges), pa.int64())], schema=schema)

    return run


def near_duplicates(df: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", trees: int = 4, leaf_rows: int = 500, sample: int = 20_000,
                    block: int = 2_000) -> DataFrame:
    """Links of cosine ``least`` or more between vectors of the same label, and their components.

    One row per row of ``df``: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, itself included), kept. Vectors that
    are null, empty, zero or hold null or non-finite numbers, and rows with a
    null label or key, link with nothing. Rows with equal vectors and label are
    one vector that counts as often as it occurs; they link with each other.

    A forest is fitted on a sample of at most ``sample`` vectors (lowest hashes
    of their ids), deep enough for some ``leaf_rows`` vectors of the largest
    label in a leaf, as far as the sample carries and one split at least. All
    vectors go down all trees. Leaves that are still large get trees of their own
    below them, fitted on some 1,000 of their rows, until they are small or
    would send most of their rows both ways. Two unit vectors at cosine 0.98
    are 0.2 apart; along a random direction in 64 dimensions that is 0.025 on
    average, and the spill is as wide on each side of a cut. Such a pair is
    missed by one tree in about a hundred, and by all four in 10**8; closer pairs
    far less often. Inside a leaf all pairs are compared in blocks of ``block``
    rows, so a leaf that does not split (very many near copies) spreads over
    tasks. A pair that shares several leaves counts in the first. Blocks return a
    count per vector and a spanning forest of links, never all pairs.
    """
    spark = df.sparkSession
    whole = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("vec_id"),
                      F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & sound & (norm > 0)
    good = whole.where(fit)
    # Vectors of unlike length cannot be compared; each length is a space of its own.
    classes = checkpointed(
        good.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    shape = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    counts, links = [], []
    for d in (r.d for r in shape):
        own = classes.where(F.size("v") == d)
        spill = float(np.sqrt(2 - 2 * least) / np.sqrt(d))
        placed = checkpointed(_place(own, d, spill, trees, leaf_rows, sample))
        placed = _deepened(placed, d, spill, leaf_rows)
        found = checkpointed(_links(placed, d, least, block))
        counts.append(found.where("n IS NOT NULL").select(F.col("a").alias("id"), "n"))
        links.append(found.where("n IS NULL").select("a", "b"))
    empty_links = spark.createDataFrame([], "a long, b long")
    empty_counts = spark.createDataFrame([], "id long, n long")
    for x in links:
        empty_links = empty_links.unionByName(x)
    for x in counts:
        empty_counts = empty_counts.unionByName(x)
    by_class = empty_counts.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(empty_links)
    marked = (
        classes.join(by_class, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component_id")))
    found = good.select("vec_id", "label", "v").join(marked, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = whole.where(~F.coalesce(fit, F.lit(False))).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unit(column: pa.Array, dimensions: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place(classes: DataFrame, dimensions: int, spill: float, trees: int, leaf_rows: int, sample: int) -> DataFrame:
    """Leaves of every class vector."""
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = max(1, int(np.ceil(np.log2(max(1, largest) / leaf_rows))))
    some = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").toArrow().sort_by("id")
    depth = min(depth, max(1, int(np.log2(max(1, some.num_rows) / 4))))
    forest = Forest.fit(_unit(some.column("v").combine_chunks(), dimensions), trees, depth, spill)
    schema = to_arrow_schema(_PLACED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(3), dimensions)
            row, leaf = forest.leaves(x)
            order = np.lexsort((leaf, row))
            places = np.split(leaf[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([y.tobytes() for y in x], pa.binary()),
                 pa.array(places, pa.list_(pa.int64()))], schema=schema)

    return classes.select("id", "label", "weight", "v").mapInArrow(run, _PLACED)


def _deepened(placed: DataFrame, dimensions: int, spill: float, leaf_rows: int, sample: int = 1_000) -> DataFrame:
    """``placed`` with leaves of more than four times ``leaf_rows`` split further, level by level.

    A level's leaves carry its number in their top byte. Some ``sample`` rows of
    a leaf, those with the lowest hashes, fit its tree, wherever they lie; the
    trees meet the rows of their leaves in a join.
    """
    shift, low = 56, (1 << 56) - 1
    cuts = StructType([StructField("label", StringType()), StructField("leaf", LongType()), StructField("cuts", BinaryType())])
    schemas = to_arrow_schema(cuts), to_arrow_schema(_PLACED)

    def seed(leaf: int) -> int:
        return leaf & (1 << 63) - 1

    def fit(table: pa.Table) -> pa.Table:
        n, leaf = table.column("n")[0].as_py(), table.column("leaf")[0].as_py()
        depth = min(7, int(np.ceil(np.log2(n / leaf_rows))))
        x = np.frombuffer(b"".join(table.sort_by("id").column("v").to_pylist()), float).reshape(-1, dimensions)
        tree = Subtree.fit(x, depth, spill, seed(leaf))
        return pa.Table.from_pylist([] if np.isnan(tree.cuts[0]) else [
            {"label": table.column("label")[0].as_py(), "leaf": leaf, "cuts": tree.cuts.tobytes()}], schema=schemas[0])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), float).reshape(-1, dimensions)
            leaf, trees = batch.column(4).to_numpy(), batch.column(5).to_pylist()
            number = {}
            which = np.array([number.setdefault(c, len(number)) for c in trees])
            places = [None] * len(x)
            for own in np.unique(which):
                at = np.flatnonzero(which == own)
                for parent in np.unique(leaf[at]):
                    here = at[leaf[at] == parent]
                    tree = Subtree(np.frombuffer(trees[here[0]], float), dimensions, spill, seed(int(parent)))
                    first = ((int(parent) >> shift) + 1 << shift) + (int(parent) & low >> 8) * 256
                    for row, node in zip(*tree.leaves(x[here]), strict=True):
                        places[here[row]] = [*(places[here[row]] or []), first + int(node)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(places, pa.list_(pa.int64()))], schema=schemas[1])

    names = ["id", "label", "weight", "v"]
    for level in range(5):  # 12 bits of a first leaf and two of its tree, eight for each level
        spread = placed.withColumn("leaf", F.explode("leaves"))
        newest = spread.where(F.shiftright("leaf", shift) == level)
        large = stored(newest.groupBy("label", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 4 * leaf_rows), "large")
        if large.isEmpty():
            break
        lowest = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(float(1 << 40)) * sample / F.col("n")
        some = newest.join(large, ["label", "leaf"]).where(lowest)
        trees = stored(some.groupBy("label", "leaf").applyInArrow(fit, cuts), "trees")
        if trees.isEmpty():
            break
        below = spread.join(trees, ["label", "leaf"]).select(*names, "leaf", "cuts").mapInArrow(split, _PLACED)
        rest = spread.join(trees, ["label", "leaf"], "left_anti").select(*names, F.array("leaf").alias("leaves"))
        placed = checkpointed(below.unionByName(rest).groupBy(*names).agg(F.flatten(F.collect_list("leaves")).alias("leaves")))
    return placed


def _links(placed: DataFrame, dimensions: int, least: float, block: int) -> DataFrame:
    """Link counts (a, null, n) and joining links (a, b, null), leaf by leaf in blocks."""
    spread = placed.withColumn("leaf", F.explode("leaves"))
    sizes = spread.groupBy("label", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = spread.join(sizes, ["label", "leaf"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = dealt.withColumn("other", other).select(
        "label", "leaf", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "id", "weight", "v", "leaves")
    return cells.groupBy("label", "leaf", "one", "two").applyInArrow(_cell(least, dimensions), _FOUND)
