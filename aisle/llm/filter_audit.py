"""Audit of how text filters interact: survivors, removals, redundancies and label losses in every order.

One table of failing ids is stored for each filter. Which rows are left after a
prefix of an order depends only on the set of its filters, so left-anti joins
walk the sets of 0, 1, 2, ... filters once, and left-semi joins give what each
further filter removes. Only ids travel; texts are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from aisle.session import scratch_path

#: Blanks between words (fixed value).
_BLANK = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are not blanks, as an array."""
    inner = F.btrim(text, F.lit(_BLANK))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{_BLANK}]+"))


def short(words: Column, least: int = 200) -> Column:
    """Fewer words than ``least``."""
    return F.size(words) < least


def repetitive(words: Column, percent: int = 50) -> Column:
    """Less than ``percent`` in a hundred words are distinct. A text without words is not."""
    return 100 * F.size(F.array_distinct(words)).cast("bigint") < percent * F.size(words).cast("bigint")


def shouting(text: Column, percent: int = 3) -> Column:
    """More than ``percent`` in a hundred code points are A-Z."""
    letters = F.regexp_count(text, F.lit("[A-Z]"))
    return 100 * letters.cast("bigint") > percent * F.length(text).cast("bigint")


def symbols(text: Column, any_of: str = "#$%&*|") -> Column:
    """Holds one of the characters ``any_of``."""
    return reduce(Column.__or__, [text.contains(c) for c in any_of])


@dataclass
class Relations:
    """Stored tables of an audit: ``members`` (row, part, good, toxic) and failing ``row`` ids by filter name."""

    members: DataFrame
    failing: dict[str, DataFrame]


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut."""
    df.write.parquet(where := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(where)


def repeats_smaller(rows: DataFrame, salts: int = 64) -> DataFrame:
    """Rows whose text a smaller doc_id holds too. ``rows`` has row, doc_id and digest (of the text).

    Digests are counted by (digest, salt) first, so a text that a third of all
    rows share is spread over the salts in both directions. A null doc_id comes
    before all others; rows of one doc_id do not repeat each other.
    """
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    salted = rows.select("row", "digest", F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"), order.alias("at"))
    some = salted.groupBy("digest", "salt").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    first = some.groupBy("digest").agg(F.min("low").alias("first"), F.max("high").alias("last")).where("first < last")
    bounds = some.select("digest", "salt").join(first.select("digest", "first"), "digest")
    return salted.join(bounds, ["digest", "salt"]).where("at > first").select("row")


def relations(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], copies: str | None,
              key: str = "doc_id", text: str = "text", part: str = "lang") -> Relations:
    """Store the members and one table of failing ids for each filter, in the shared folder.

    ``conditions`` are boolean columns over ``_text`` (null text: empty) and
    ``_words`` (its words, an array); a null condition does not fail. ``copies`` names one more filter: identical to the
    text of a smaller id. Every row is a member of its own, under a number
    given when it is written, so repeated and null ids stay apart; labels are
    found by id, and an id counts as good or toxic if any of its label rows
    says so. Part is the text of column ``part`` (null: empty).
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
                        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).withColumn(
        "_words", words_of(F.col("_text")))
    facts, folder = scratch_path(spark, "facts"), scratch_path(spark, "failing")
    named.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "part", F.sha2("_text", 256).alias("digest"),
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()])).alias("fails"),
    ).write.parquet(facts)
    rows = spark.read.parquet(facts)

    known = labels.where(f"{key} IS NOT NULL").groupBy(F.col(key).cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id have no label; their number as a second key keeps them from meeting in one task.
    alone = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.lit(-1))
    marked = rows.withColumn("_alone", alone).join(known.withColumn("_alone", F.lit(-1).cast("bigint")),
                                                   ["doc_id", "_alone"], "left")
    members = _written(marked.select("row", "part", F.coalesce("good", F.lit(0)).alias("good"),
                                     F.coalesce("toxic", F.lit(0)).alias("toxic")), "members")

    failing = {}
    for name in conditions:
        rows.where(F.array_contains("fails", name)).select("row").write.parquet(f"{folder}/{name}")
    if copies is not None:
        repeats_smaller(rows).write.parquet(f"{folder}/{copies}")
    for name in [*conditions, *([copies] if copies else [])]:
        failing[name] = spark.read.schema("row bigint").parquet(f"{folder}/{name}")
    return Relations(members, failing)


def _stacked(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def prefix_counts(stored: Relations, sets: set[frozenset[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts along the sets of filters: totals, steps and unique failures.

    totals: part, rows. steps: part, prefix (bits of the filters that ran, in the
    order of ``stored.failing``), filter, removed, good_lost, toxic_lost, kept,
    redundant. unique: part, filter, unique_fails. Parts without a row in a
    count are left out there.

    Rows that fail nothing pass every prefix and are only counted. The others
    carry the prefix they have passed: those that a filter does not fail
    (left-anti) go on, those that it fails (left-semi) are its removals. Sets of
    one size are walked together and written, so a lost executor costs one
    level. There are at most (filters x sets) rows for each failing id.
    """
    names = list(stored.failing)
    bit = {n: 1 << i for i, n in enumerate(names)}
    mask = {s: sum(bit[n] for n in s) for s in sets}
    fails = _stacked([stored.failing[n].select("row", F.lit(bit[n]).alias("bit")) for n in names])
    totals = stored.members.groupBy("part").agg(F.count("*").alias("rows"))
    some = _written(stored.members.join(fails.select("row").distinct(), "row", "left_semi"), "some")

    def further(left: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
        """Rows of a prefix with each filter that comes next: column ``bit``."""
        nexts = F.create_map(*[F.lit(x) for p in sorted({p for p, _ in steps}) for x in (
            p, [b for q, b in steps if q == p])])
        return left.withColumn("bit", F.explode(nexts[F.col("prefix")]))

    # Each step once; each set is reached by one of its steps, and its survivors are written.
    steps = sorted({(mask[s - {n}], bit[n]) for s in sets for n in s if s - {n} in sets or len(s) == 1})
    reached = {p + b: (p, b) for p, b in steps}
    level = some.select("row", "part", "good", "toxic", F.lit(0).alias("prefix"))
    survivors = []
    for size in range(max(map(len, sets), default=0) + 1):
        survivors.append(_written(level, f"survivors{size}"))
        ways = [way for way in reached.values() if bin(way[0]).count("1") == size]
        if not ways:
            break
        left = further(survivors[-1], ways).join(fails, ["row", "bit"], "left_anti")
        level = left.select("row", "part", "good", "toxic", (F.col("prefix") + F.col("bit")).alias("prefix"))
    alive = _stacked(survivors)

    removed = _written(further(alive, steps).join(fails, ["row", "bit"], "left_semi").groupBy(
        "part", "prefix", "bit").agg(F.count("*").alias("removed"), F.sum("good").alias("good_lost"),
                                     F.sum("toxic").alias("toxic_lost")), "removed")
    kept = _written(alive.groupBy("part", "prefix").agg(F.count("*").alias("left")), "kept")
    # A failing id that did not survive the prefix was removed before.
    before = F.create_map(*[F.lit(x) for b in sorted({b for _, b in steps}) for x in (
        b, [p for p, c in steps if c == b])])
    placed = _written(fails.join(some.select("row", "part"), "row"), "placed")
    gone = placed.withColumn("prefix", F.explode(before[F.col("bit")])).join(
        alive.select("row", "prefix"), ["row", "prefix"], "left_anti")
    redundant = _written(gone.groupBy("part", "prefix", "bit").agg(F.count("*").alias("redundant")), "redundant")
    other = fails.select(F.col("row").alias("_row"), F.col("bit").alias("_bit"))
    alone = placed.join(other, (F.col("row") == F.col("_row")) & (F.col("bit") != F.col("_bit")), "left_anti")
    unique = alone.groupBy("part", "bit").agg(F.count("*").alias("unique_fails"))

    clean = totals.join(some.groupBy("part").agg(F.count("*").alias("failing")), "part", "left").select(
        "part", (F.col("rows") - F.coalesce("failing", F.lit(0))).alias("clean"))
    parts = totals.select("part").withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    spark = stored.members.sparkSession
    listed = spark.createDataFrame([(i, p, b, p + b) for i, (p, b) in enumerate(steps)],
                                   "_step int, prefix int, bit int, after int")
    after = kept.withColumnRenamed("prefix", "after")
    out = parts.join(listed, "_step").join(clean, "part").join(after, ["part", "after"], "left").join(
        removed, ["part", "prefix", "bit"], "left").join(redundant, ["part", "prefix", "bit"], "left")
    zero = {c: 0 for c in ("left", "removed", "good_lost", "toxic_lost", "redundant")}
    counted = out.fillna(zero).select("part", "prefix", "bit", (F.col("clean") + F.col("left")).alias("kept"),
                                      "removed", "redundant", "good_lost", "toxic_lost")
    return totals, counted, unique


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], orders: Sequence[str],
          copies: str | None = None, **columns: str) -> DataFrame:
    """One row per part, order and step of ``orders`` (words of one-letter filter names), zeros included.

    Columns: part, filter_order, step (from 1; its filter is that letter), kept
    (rows left after the step), removed (in the step), redundant (rows that fail
    the filter but were removed earlier), unique_fails (rows that fail this
    filter only), good_lost and toxic_lost (removed rows with these labels) and
    shapley (the filter's removals, summed over all ``orders``). Orders may be of
    any length. An empty table has no parts and gives no rows. See ``relations``
    for nulls and repeated ids; other columns of ``docs`` are not read.
    """
    stored = relations(docs, labels, conditions, copies, **columns)
    names = list(stored.failing)
    if any(len(set(o)) != len(o) or not set(o) <= set(names) for o in orders):
        raise ValueError("an order names each of the filters at most once")
    sets = {frozenset(o[:i]) for o in orders for i in range(len(o) + 1)}
    totals, counted, unique = prefix_counts(stored, sets)
    bit = {n: 1 << i for i, n in enumerate(names)}
    lines = [(o, i + 1, sum(bit[n] for n in o[:i]), bit[o[i]]) for o in orders for i in range(len(o))]
    spark = docs.sparkSession
    listed = spark.createDataFrame([(i, *line) for i, line in enumerate(lines)],
                                   "_line int, filter_order string, step int, prefix int, bit int")
    parts = totals.select("part").withColumn("_line", F.explode(F.sequence(F.lit(0), F.lit(len(lines) - 1))))
    full = parts.join(listed, "_line").join(counted, ["part", "prefix", "bit"]).join(
        unique, ["part", "bit"], "left").fillna(0, ["unique_fails"])
    total = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return full.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                       "good_lost", "toxic_lost", total.cast("bigint").alias("shapley"))


def text_filters() -> dict[str, Column]:
    """The filters A to D of the registered audit: short, repetitive, shouting, symbols."""
    text, words = F.col("_text"), F.col("_words")
    return {"A": short(words), "B": repetitive(words), "C": shouting(text), "D": symbols(text)}
