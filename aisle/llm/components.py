"""Connected components of a link table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aisle.session import checkpointed


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable by links: node, component. ``links`` has a and b (long); no loops are needed.

    Each round turns every node's links toward the smallest node it sees: first
    larger neighbours are linked to the smallest one, then smaller ones. The
    number of links does not grow; the rounds are few (about the logarithm of
    the longest path), each is two shuffles, and each is checkpointed. A node
    that many links share is reduced by partial minima before it is shuffled.
    Stops when the links no longer change; then all of them point to the root.
    """
    both = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpointed(both)
    for _ in range(most_rounds):
        # Larger neighbours (and the node) go to the smallest neighbour.
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        # Smaller neighbours and the node itself go to the smallest neighbour.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        new = checkpointed(
            small.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        # Each node with one link, to a node that has none upward: every component is a star.
        ends = new.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            new.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ones = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where(
            "up > 1 OR (up = 1 AND down = 1)")
        edges = new
        if not open_ones.count():
            break
    else:
        raise RuntimeError("links did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
