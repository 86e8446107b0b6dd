"""Shared scratch tables: how a job cuts its lineage so that lost executors cost little."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a local session names none (tests), a temporary one.

    A cluster has to name one: its executors do not see each other's temporary folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the whole cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='cytoloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and return the reread table.

    Unlike a cached or locally checkpointed frame the rows outlive the executors that made them, and later
    steps read only the columns they need.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared scratch folder where nothing is yet."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession, rows: int = 1_000, megabytes: int = 8) -> None:
    """Lower the session's Arrow batches where they are larger, so that a Python worker holds little of long rows at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = spark.conf.get(key)
        if not now.rstrip("b").isdigit() or int(now.rstrip("b")) <= 0 or int(now.rstrip("b")) > most:
            spark.conf.set(key, str(most))
