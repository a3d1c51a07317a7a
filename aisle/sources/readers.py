"""Readers: CSV, Parquet, snapshots, many files, header repair and source tags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from aisle.functions.exprs import col
from aisle.session import checkpointed


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", **options) -> DataFrame:
    """Delimited text with a header and a stated schema."""
    return spark.read.options(header=True, sep=sep, **options).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_month(spark: SparkSession, path: str, month: str, column: str = "month") -> DataFrame:
    """One month of a folder partitioned by month; only that partition is listed and read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(month))


def read_latest_snapshot(spark: SparkSession, path: str, column: str = "version") -> DataFrame:
    """Rows of the highest snapshot of a folder partitioned by snapshot number.

    The newest number comes from the partition values alone, and the equality
    on it prunes every other partition.
    """
    frame = spark.read.parquet(path)
    newest = frame.agg(F.max(column)).first()[0]
    return frame.where(F.col(column) == F.lit(newest)).drop(column)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)


def read_many(
    paths: Iterable[str], reader: Callable[[str], DataFrame]
) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the readable files by column name, and the error text of the others."""
    merged, failed = None, {}
    for path in paths:
        try:
            frame = reader(path)
            frame.schema
        except PySparkException as error:
            failed[path] = str(error).splitlines()[0]
            continue
        merged = frame if merged is None else merged.unionByName(frame, allowMissingColumns=True)
    return merged, failed


def read_files(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Rows of many Parquet files, each damaged file left out alone, and a report with one row per file.

    The paths are files or folders, read as one table whose columns are united
    by name. The report has path, bytes, rows (as the file's footer counts
    them), rows_read (when every column is decoded) and status: ``read``;
    ``damaged`` (fewer rows than the footer says: none of them are in the
    result); ``nothing read`` (no readable footer, or no rows); ``missing`` (a
    path that does not exist). The report decodes the data once more than the
    result does; both are single jobs whatever the number of files.
    """
    listed, missing = [], []
    for path in paths:
        try:
            listing = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path)
            listed.append(listing.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes")))
        except PySparkException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
    if not listed:
        raise FileNotFoundError(", ".join(missing))
    frame = spark.read.options(
        ignoreCorruptFiles="true", ignoreMissingFiles="true", mergeSchema="true", recursiveFileLookup="true"
    ).parquet(*[p for p in paths if p not in missing])
    files = reduce(DataFrame.unionByName, listed).distinct()
    path = F.col("_metadata.file_path").alias("path")
    counted = frame.select(path).groupBy("path").agg(F.count("*").alias("rows"))
    # The hash of all columns makes the reader decode them.
    decoded = frame.select(path, F.xxhash64(*frame.columns).alias("_hash")).groupBy("path").agg(
        F.count("*").alias("rows_read"), F.max("_hash").alias("_hash")).where("_hash IS NOT NULL")
    status = (F.when(F.col("rows").isNull(), "nothing read").when(F.coalesce("rows_read", F.lit(0)) < F.col("rows"), "damaged")
              .otherwise("read"))
    found = files.join(counted, "path", "left").join(decoded, "path", "left").withColumn("status", status)
    lost = spark.createDataFrame(
        [(p, None, None, None, "missing") for p in missing], "path string, bytes long, rows long, rows_read long, status string")
    report = checkpointed(found.select(*lost.columns).unionByName(lost))
    damaged = report.where("status = 'damaged'").select(F.col("path").alias("_path"))
    kept = frame.withColumn("_path", F.col("_metadata.file_path")).join(damaged, "_path", "left_anti").drop("_path")
    return kept, report


def promote_header(df: DataFrame, order: str, n: int = 0) -> DataFrame:
    """Use the n-th data row (by ``order``) as header and drop it and the rows above it.

    Only the n + 1 top rows reach the driver.
    """
    columns = [c for c in df.columns if c != order]
    top = df.orderBy(order).limit(n + 1).collect()[-1]
    names = [str(top[c]).strip() if top[c] is not None else c for c in columns]
    rest = df.where(F.col(order) > F.lit(top[order]))
    return rest.select(*[F.col(c).alias(name) for c, name in zip(columns, names)])


def tag_source(df: DataFrame, pattern: str, *names: str) -> DataFrame:
    """Add columns taken from the file name by the groups of ``pattern``."""
    file = F.col("_metadata.file_path")
    tags = [F.regexp_extract(file, pattern, i + 1).alias(name) for i, name in enumerate(names)]
    return df.select("*", *tags)


def parse_report_range(text: Column | str) -> list[Column]:
    """First two ISO dates of a report header as start and end."""
    text = col(text)
    day = r"(\d{4}-\d{2}-\d{2})"
    pattern = f"{day}[^0-9]+{day}"
    return [
        F.try_to_date(F.regexp_extract(text, pattern, 1)).alias("report_start"),
        F.try_to_date(F.regexp_extract(text, pattern, 2)).alias("report_end"),
    ]


def clean_name(name: str) -> str:
    """Lower-case identifier: other characters become single underscores, none at the ends."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-zA-Z]+", "_", name)).strip("_").lower()


def clean_columns(df: DataFrame) -> DataFrame:
    """Normalise all column names; a repeated name gets a running number."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = clean_name(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)
