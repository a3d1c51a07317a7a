"""Session set-up and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "aisle", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; extra settings go in as key=value."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="aisle-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """New path for a written intermediate result, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, and of a size that Spark knows."""
    df.write.parquet(where := scratch_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(where)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, jobs that run send at most ``rows`` rows at once to Python; the session's own number comes back after."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(setting))
    spark.conf.set(setting, str(min(own, rows) if own > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, str(own))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition a frame whose scan has fewer tasks than the session has cores.

    Only a small input (few row groups) is moved this way; a large one already
    fills the cluster and stays as it is. ``keys`` must be unique or nearly so.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """Hash-partition a frame of ``rows`` rows into parts of about ``most``, where the cores alone would make larger ones.

    Tasks after a shuffle are cut by the bytes shuffled, which say little about
    the memory that rows packed well take there; a part of this frame has the
    same size however large the whole is. A smaller frame stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(-(-rows // most), *keys) if rows > most * cores else df
