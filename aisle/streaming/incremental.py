"""Incremental batches: append rows whose key is new, reload folders that changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from aisle.operators.joins import dedupe


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Rows whose key is not stored yet, one per key (first by ``order``)."""
    unseen = incoming.join(stored.select(*keys), list(keys), "left_anti").select(*incoming.columns)
    return dedupe(unseen, keys, order)


def append_new(incoming: DataFrame, path: str, keys: Sequence[str], order: Sequence) -> None:
    """Append the new rows to a Parquet folder; the first call creates it."""
    spark = incoming.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        dedupe(incoming, keys, order).write.parquet(path)
        return
    new_rows(incoming, stored, keys, order).write.mode("append").parquet(path)


def changed_files(spark: SparkSession, path: str, since: str) -> DataFrame:
    """Files of a folder modified after a time, from file metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length").where(
        F.col("modificationTime") > F.lit(since).cast("timestamp")
    )
