"""Corpus pipeline: quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as
Parquet and read again as the next stage's documents. All but the last give the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from aisle.llm import jaccard, lines, packing, quality
from aisle.session import scratch_path, stored

#: Rows that travel to Python at once; whole texts go there, and an executor runs several workers.
BATCH_ROWS = 1_000

_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ``BATCH_ROWS``, from here on: a stage runs when its result is written."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (learned from the labels of these documents) does not reject."""
    small_batches(spark)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, keep=_COLUMNS[1:])
    return scored.where("predicted = 1").select(*_COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text.

    Five copies or more, near ones included, repeat their own lines, and only the
    largest id keeps them. The other copies go here, as the next stage could not
    tell what is left of them (less than a tenth of the words); so do documents of
    which no word is left.
    """
    small_batches(spark)
    kept = lines.dedup_lines(docs, keep=["lang", "source", "n_chars"], stubs=False)
    return kept.withColumn(
        "n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    ).select(*_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents stays, the one with the smallest id.

    Shingles of five words, a similarity of 0.8 or more. Documents without words
    are one class. Rows without an id are in no class and stay. Rows that repeat
    an id are in the class of that id together, and all stay if it is the smallest.
    """
    small_batches(spark)
    found = jaccard.similar_documents(docs, words=5, percent=80)
    wordless = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("n_shingles").alias("most"), F.max(F.col("component_id") != F.col("doc_id")).alias("other"))
    first = wordless.where("most = 0").agg(F.min("doc_id")).first()[0]
    gone = F.col("other") | (F.col("most") == 0) & (F.col("doc_id") > F.lit(first)) if first is not None else F.col("other")
    # Stored, so that Spark knows its size: few ids go to the texts, many are joined with them.
    others = stored(wordless.where(gone).select("doc_id"), "others")
    return docs.join(others, "doc_id", "left_anti").select(*_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("best-fit packing", pack),
]

#: The classifier and the tokenizer have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            where = scratch_path(spark, f"stage{number}")
            out.write.parquet(where)
            docs = spark.read.schema(out.schema).parquet(where)
    return out
