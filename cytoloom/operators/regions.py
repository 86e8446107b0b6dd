"""Reading the alignments of a region through an index of hierarchical bins.

The index has two tables.  Chunks are stretches of records of one bin that follow each other in a file, from a first to a
last virtual offset.  Windows of 16 kb tell the first record that reaches into them.  A region's records stand in the
chunks of the bins that may overlap it, behind the first record of its first window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cytoloom.operators.filters import islands
from cytoloom.schemas import ALIGNMENTS
from cytoloom.sources import bam

#: Fixed values of the index: bits of the smallest bins, levels below the bin of everything, bits a level.
SHIFT, DEPTH, STEP = 14, 5, 3
#: Bytes of a file that are rather read than passed over.
GAP = 1 << 16
LEVELS = [(((1 << STEP * level) - 1) // 7, SHIFT + STEP * (DEPTH - level)) for level in range(DEPTH, 0, -1)]


def interval_bin(start: Column | str, end: Column | str) -> Column:
    """The smallest bin that holds all of [start, end); an empty interval counts as one base, bin 0 holds everything."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    last = F.greatest(end, start + 1) - 1
    out = F.lit(0).cast("long")
    for first, shift in reversed(LEVELS):
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.shiftright(start, shift) + first).otherwise(out)
    return out


def bins_over(bin_: Column, start: int, end: int) -> Column:
    """Whether a bin may hold intervals that overlap [start, end)."""
    found = bin_ == 0
    for first, shift in LEVELS:
        found = found | bin_.between(first + (start >> shift), first + (max(end, start + 1) - 1 >> shift))
    return found


def chunk_index(alignments: DataFrame) -> DataFrame:
    """(file_id, chrom, bin, begin, last, n_records) of a table read from BAM files, for records that have a place."""
    placed = alignments.where("chrom is not null and pos >= 0").select("file_id", "ordinal", F.struct("chrom", interval_bin("pos", "end_pos").alias("bin")).alias("at"))
    runs = islands(placed, ["file_id"], "ordinal", "at")
    return runs.select("file_id", "at.chrom", "at.bin", F.col("first_ordinal").alias("begin"), F.col("last_ordinal").alias("last"), F.col("n_rows").alias("n_records"))


def window_index(alignments: DataFrame) -> DataFrame:
    """(file_id, chrom, window, first): the least virtual offset of the records that reach into each window of 16 kb."""
    placed = alignments.where("chrom is not null and pos >= 0")
    windows = F.sequence(F.shiftright("pos", SHIFT), F.shiftright(F.greatest(F.col("end_pos"), F.col("pos") + 1) - 1, SHIFT))
    return placed.select("file_id", "ordinal", "chrom", F.explode(windows).alias("window")).groupBy("file_id", "chrom", "window").agg(F.min("ordinal").alias("first"))


def region_chunks(chunks: DataFrame, windows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """The chunks that may hold records over the region."""
    first = windows.where((F.col("chrom") == chrom) & F.col("window").between(start >> SHIFT, max(end, start + 1) - 1 >> SHIFT)).groupBy("file_id").agg(F.min("first").alias("first"))
    near = chunks.where((F.col("chrom") == chrom) & bins_over(F.col("bin"), start, end))
    return near.join(first, "file_id").where("last >= first").select("file_id", F.greatest("begin", "first").alias("begin"), "last")


def read_region(chunks: DataFrame, windows: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Alignments that overlap [start, end) of a reference, with ``n_blocks``.

    Chunks are read where they stand, by as many tasks as there are stretches of 64 MB with such chunks.  A row whose
    ``ordinal`` is null counts in ``n_blocks`` the blocks that a task has inflated; ``n_blocks`` of an alignment is 0.
    """
    schema = bam.SCHEMA.append(pa.field("n_blocks", pa.int64()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, list[str]] = {}
        for path, spans in _together(batches):
            if path not in names:
                names = {path: bam.read_header(path)[0]}
            opened = [0]
            begins, lasts = spans[:, 0], spans[:, 1]
            for data, at, offsets in bam.record_buffers(path, int(begins[0]) >> 16, int(begins[0]) & 0xFFFF, int(lasts[-1]) + 1, None, opened):
                span = np.searchsorted(begins, offsets, "right") - 1
                inside = offsets <= lasts[span]
                for i in range(0, int(inside.sum()), bam.ROWS):
                    batch = bam.decode(path, names[path], data, at[inside][i : i + bam.ROWS], offsets[inside][i : i + bam.ROWS])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(len(batch), np.int64))], schema=schema)
            counted = [pa.array([path]), *[pa.nulls(1, f.type) for f in bam.SCHEMA][1:], pa.array(opened, pa.int64())]
            yield pa.RecordBatch.from_arrays(counted, schema=schema)

    near = region_chunks(chunks, windows, chrom, start, end).withColumn("stretch", F.shiftright("begin", 16 + 26))
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    found = near.repartition(cores, "file_id", "stretch").sortWithinPartitions("file_id", "begin").select("file_id", "begin", "last").mapInArrow(read, f"{ALIGNMENTS}, n_blocks long")
    return found.where((F.col("n_blocks") > 0) | (F.col("chrom") == chrom) & (F.col("pos") < end) & (F.greatest(F.col("end_pos"), F.col("pos") + 1) > start))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(file, its chunks) for sorted chunks, where chunks no farther apart than GAP bytes of the file are read as one stretch."""
    path, held = None, []
    for batch in batches:
        for name, begin, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if held and (name != path or begin >> 16 > (held[-1][1] >> 16) + GAP):
                yield path, np.array(held, np.int64)
                held = []
            path = name
            held.append((begin, last))
    if held:
        yield path, np.array(held, np.int64)
