"""Writers: Parquet, tables, dynamic partitions, per-group output, CSV registration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Overwrite a folder; ``files`` fixes the number of output files."""
    (df if files is None else df.repartition(files)).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str, *partitions: str, path: str | None = None) -> None:
    """Overwrite a table, schema included; ``path`` makes it an external one."""
    writer = df.write.mode("overwrite").option("overwriteSchema", "true").partitionBy(*partitions)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def write_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Overwrite only the partitions present in ``df``.

    The rebalance hint lets adaptive execution split a hot partition value over
    several tasks, so one value never passes through a single writer.
    """
    (
        df.hint("rebalance", *columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def write_by_group(df: DataFrame, path: str, column: str, fmt: str = "parquet") -> None:
    """One output folder per value of ``column``."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).format(fmt).save(path)


def register_csv(spark: SparkSession, name: str, path: str, sep: str = ",") -> None:
    """Make a CSV folder queryable as a table."""
    spark.catalog.createTable(name, path=path, source="csv", header="true", inferSchema="true", sep=sep)
