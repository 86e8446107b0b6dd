"""The mergeable per-cell results over streams of reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cytoloom.operators import counts, kmers
from cytoloom.plans.views import SOURCES, pieces
from cytoloom.scratch import scratch_dir

FIELDS = ("high", "low", "kmer", "cnt")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over what its source holds now, and return its last result.

    Each micro-batch replaces the table, so a batch that is repeated after a failure leaves the same rows.
    """
    spark = stream.sparkSession
    path = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def histogram_stream(reads: DataFrame) -> DataFrame:
    return counts.cell_histogram(reads)


def sketch_stream(reads: DataFrame, k: int, size: int, by: str = "xxhash64") -> DataFrame:
    """The count sketch is a sum and so keeps one number of state for each cell and place."""
    return kmers.count_sketch(reads, k, size, by)


class CellSketch(StatefulProcessor):
    """The bottom-n sketch of a cell as its state: at most n rows, whatever the number of its reads.

    Each trigger emits the cell's sketch anew.  A cell of which nothing is heard for ``idle_ms`` is closed: its state is
    dropped, as in a file sorted by cell, where the next cell closes the one before.  Reads that come after that begin a
    new sketch.
    """

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "high array<long>, low array<long>, kmer array<string>, cnt array<long>")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        parts = [pa.Table.from_pandas(f[["cell_id", *FIELDS]], preserve_index=False) for f in rows]
        if self.held.exists():
            held = dict(zip(FIELDS, self.held.get()))
            parts.append(pa.table({"cell_id": [key[0]] * len(held["cnt"]), **{c: list(held[c]) for c in FIELDS}}, schema=parts[0].schema))
        best = kmers._least(pa.concat_tables([p.cast(parts[0].schema) for p in parts]), self.n)
        self.held.update(tuple(best[c].to_pylist() for c in FIELDS))
        if self.idle_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        cnt = best["cnt"].to_numpy()
        before = np.cumsum(cnt) - cnt
        yield pd.DataFrame({"cell_id": key[0], "kmer": best["kmer"].to_pylist(), "copies": np.minimum(cnt, self.n - before)})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def minhash_stream(reads: DataFrame, k: int, n: int, by: str = "xxhash64", idle_ms: int | None = None) -> DataFrame:
    """The n windows of each cell with the smallest hash, repeats included, over a stream.

    The tasks that read hand on the n best of their cells; these are merged into the cell's state.  With ``idle_ms`` the
    query has timers, for which it goes on after its source has run dry, so it needs a trigger that repeats.
    """
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = kmers.sketch_parts(reads, k, n, by)
    return parts.groupBy("cell_id").transformWithStateInPandas(CellSketch(n, idle_ms), "cell_id string, kmer string, copies long", "Update", "None" if idle_ms is None else "ProcessingTime")


def latest_by_cell(stream: DataFrame) -> DataFrame:
    """The last rows that an update stream emitted for each cell, after it has taken in what its source holds now."""
    from pyspark.sql import functions as F

    spark = stream.sparkSession
    path = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/number={number}")

    stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out")
    newest = rows.groupBy("cell_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["cell_id", "batch"]).select(stream.columns)


def read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, r1 and r2 of the documents' read view, read as a stream of files."""
    table, columns = SOURCES["reads"]
    source = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(source).schema
    # The file source takes a folder or a pattern; this pattern also fits a table of one file.
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source.removesuffix("t") + "[t]")
    return pieces(docs.select("text", "lang", "source")).selectExpr(*[f"{columns[c][0]} as {c}" for c in ("cell_id", "r1", "r2")])


def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per cell over a stream."""
    return run_to_table(histogram_stream(read_stream(spark, sf_dir)))
