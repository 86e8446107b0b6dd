"""Row filters on reads and alignments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.scratch import materialise

#: A table of up to this many rows and bytes of text is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """The table, made once, with a broadcast hint if it is proven small by its rows and the bytes of its strings."""
    made = materialise(df, "side")
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in made.schema if f.dataType.simpleString() in ("string", "binary")]
    rows, size = made.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
    return F.broadcast(made) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else made


def include_cells(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows whose cell is listed; blank lines of the list name no cell and an empty list keeps nothing."""
    return reads.join(small(cells.where("cell_id <> ''").select("cell_id").distinct()), "cell_id", "left_semi")


def mapped_enough(min_matching: int = 0, percent: int = 90) -> Column:
    """Whether a record counts as aligned: mapped, and enough of it matches absolutely or by share."""
    matched = S.matched_bases("cigar")
    share = F.lit(True) if percent == 0 else matched * 100 >= F.col("l_seq") * percent
    absolute = matched >= min_matching if min_matching > 0 else F.lit(False)
    return ~S.has_flag("flag", S.UNMAPPED) & (absolute | share)


def split_mapped(alignments: DataFrame, min_matching: int = 0, percent: int = 90, keep_unmapped: bool = False) -> DataFrame:
    """Aligned records, or all others.  Mates that follow each other in a file stay together: a pair is aligned if either is.

    A pair is a first-of-pair record and the last-of-pair record right after it under the same name.  Rows of one file
    are ordered by ``ordinal``; only names that agree can pair, so the window runs within a name.
    """
    by_name = W.partitionBy("file_id", "qname").orderBy("ordinal")
    first = S.has_flag("flag", S.PAIRED) & S.has_flag("flag", S.FIRST)
    last = S.has_flag("flag", S.PAIRED) & S.has_flag("flag", S.LAST)
    ok = alignments.withColumn("_ok", mapped_enough(min_matching, percent)).withColumn("_first", first).withColumn("_last", last)
    ok = ok.withColumn("_next", F.lead(F.struct("_last", "_ok")).over(by_name)).withColumn("_before", F.lag(F.struct("_first", "_ok")).over(by_name))
    mate = F.when(F.col("_first") & F.col("_next._last"), F.col("_next._ok")).when(F.col("_last") & F.col("_before._first"), F.col("_before._ok"))
    passed = F.col("_ok") | F.coalesce(mate, F.lit(False))
    return ok.where(~passed if keep_unmapped else passed).drop("_ok", "_first", "_last", "_next", "_before")


def unique_mappers(alignments: DataFrame) -> DataFrame:
    """Primary records of known, positive mapping quality."""
    return alignments.where(~S.has_flag("flag", S.SECONDARY | S.SUPPLEMENTARY) & (F.coalesce("mapq", F.lit(0)) > 0))


def track_records(alignments: DataFrame, skip_unmapped: bool = True, skip_secondary: bool = False, skip_supplementary: bool = False) -> DataFrame:
    bits = S.UNMAPPED * skip_unmapped | S.SECONDARY * skip_secondary | S.SUPPLEMENTARY * skip_supplementary
    return alignments.where(F.col("chrom").isNotNull() & (F.col("pos") >= 0) & ~S.has_flag("flag", bits))


def observed(rows: DataFrame, **conditions: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that counts them and those that meet each condition while an action runs over them."""
    watch = Observation()
    counters = [F.count("*").alias("rows"), *[F.count(F.when(c, 1)).alias(name) for name, c in conditions.items()]]
    return rows.observe(watch, *counters), watch


def first_per_cell(reads: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first n rows of each cell in file order."""
    return reads.withColumn("_n", F.row_number().over(W.partitionBy("cell_id").orderBy(order))).where(F.col("_n") <= n).drop("_n")


def first_pairs(reads: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first n rows of all, in file order."""
    return reads.orderBy(order).limit(n)


def long_enough(reads: DataFrame, more_than: int = 60) -> DataFrame:
    """Pairs that hold more than so many bases after trimming."""
    return reads.where(F.length("r1") + F.length("r2") > more_than)


def long_contigs(contigs: DataFrame, least: int) -> DataFrame:
    return contigs.where(F.col("len") >= least)


def cells_in_order(reads: DataFrame, cells: list[str]) -> DataFrame:
    """Rows of the listed cells with ``place``, the cell's place in the list; a cell that is listed twice counts once."""
    spark = reads.sparkSession
    places = spark.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(cells))], "cell_id string, place int")
    return reads.join(small(places), "cell_id")


def cells_with_files(files: DataFrame, names: list[str]) -> DataFrame:
    """Cells that have every one of the named files."""
    return files.where(F.col("file_name").isin(names)).groupBy("cell_id").agg(F.countDistinct("file_name").alias("n")).where(F.col("n") == len(names)).select("cell_id")


def filter_with_previous(rows: DataFrame, keep: str, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Rows for which ``keep`` holds, an expression that may name ``prev_<column>``, the value in the row before.

    Rows of one value of the keys may be split over any number of ranges.
    """
    from cytoloom.operators.layout import with_previous

    return with_previous(rows, columns, keys, [order]).where(keep).select(*rows.columns)


def assert_with_previous(rows: DataFrame, holds: str, message: str, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The rows, or an error with the message and the key of the first row at hand for which ``holds`` is false.

    ``holds`` may name ``prev_<column>``; the first row of a group has none and passes.
    """
    from cytoloom.operators.layout import with_previous

    said = F.concat_ws(" ", F.lit(message), *[F.col(c).cast("string") for c in [*keys, order]])
    checked = F.when(F.col("prev_exists") & ~F.coalesce(F.expr(holds), F.lit(False)), F.raise_error(said).cast("boolean")).otherwise(True)
    return with_previous(rows, columns, keys, [order]).where(checked).select(*rows.columns)


def assert_sorted(rows: DataFrame, column: str = "cell_id", file: str = "file_id", order: str = "ordinal") -> DataFrame:
    """The rows, or an error when one of them is less than the row before it in its file; nulls are less than all else."""
    return assert_with_previous(rows, f"prev_{column} is null or prev_{column} <= {column}", f"{column} not sorted:", [file], order, [column])


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first may differ from the one before; values that Arrow cannot compare always may."""
    if pa.types.is_struct(column.type):
        parts = [_differs(pc.struct_field(column, i)) for i in range(column.type.num_fields)]
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        return np.logical_or.reduce([valid[1:] != valid[:-1], *parts])
    if pa.types.is_nested(column.type):
        return np.ones(max(0, len(column) - 1), bool)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    same = pc.equal(column[1:], column[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
    return ~(same | ~valid[1:] & ~valid[:-1])


def _stretches(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Rows that follow each other in a batch, agree and do not fall in ``order``, as one: its first and last place and number of rows."""
    kept = rows.select(*keys, column, order)
    made = kept.select(*keys, column, F.col(order).alias("_first"), F.col(order).alias("_last"), F.lit(0).cast("long").alias("_n"))
    names = made.columns

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            *same, place = batch.columns
            rises = pc.greater(place[1:], place[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.r_[True, np.logical_or.reduce([~rises, *map(_differs, same)])])
            ends = np.r_[new[1:], len(batch)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(new)) for c in same), place.take(pa.array(new)), place.take(pa.array(ends - 1)), pa.array(ends - new)], names=names)

    return kept.mapInArrow(put_together, made.schema)


def islands(rows: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    """Adjacent rows that agree in ``column`` form a group: key columns, value, first and last place and number of rows.

    Each task first puts together the rows that follow each other as they come, as those of a file do.  Where other rows
    stand between, which two such stretches over one place tell, the rows are sorted and put together anew.  Groups that go
    over the border of batches or ranges are counted in parts, which are put together by their number.
    """
    from cytoloom.operators.layout import running_sum, with_previous

    def met(stretches: DataFrame) -> DataFrame:
        return materialise(with_previous(materialise(stretches, "stretches"), [column, "_last"], keys, ["_first"]), "islands")

    looked = met(_stretches(rows, keys, order, column))
    if not looked.where("prev_exists and not coalesce(prev__last < _first, false)").isEmpty():
        kept = materialise(rows.select(*keys, column, order), "islands")
        looked = met(_stretches(kept.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order), keys, order, column))
    same = F.col("prev_exists") & F.col(column).eqNullSafe(F.col(f"prev_{column}"))
    runs = running_sum(looked.withColumn("_new", F.when(same, 0).otherwise(1)), "_new", "_run")
    return runs.groupBy(*keys, "_run", column).agg(F.min("_first").alias("first_ordinal"), F.max("_last").alias("last_ordinal"), F.sum("_n").alias("n_rows")).drop("_run")
