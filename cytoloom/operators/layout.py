"""Shards, orders and unions of read tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.filters import small
from cytoloom.scratch import materialise


def shard_of(cell: Column | str, n: int, hashed: Column | None = None) -> Column:
    """The shard of a cell: the same for all its rows."""
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.pmod(F.xxhash64(cell) if hashed is None else hashed, F.lit(n)).cast("int")


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs with the number of the input as file_id."""
    return reduce(DataFrame.unionByName, [x.withColumn("file_id", F.lit(str(i))) for i, x in enumerate(inputs)])


def merge_sorted(inputs: list[DataFrame], shards: int) -> DataFrame:
    """Inputs merged into ``shards`` partitions, each sorted by cell, all rows of a cell in one."""
    rows = union_inputs(inputs).withColumn("shard", shard_of("cell_id", shards))
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "cell_id")


def with_place(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their place, from 0, in the order of all rows: an ordered report keeps it wherever it is written."""
    return numbered(rows, order, name=name)


def coordinate_order(alignments: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Alignments by reference, place, strand, file and record; unmapped ones last.

    References sort by name, or by ref_id of ``references`` to keep the order of a header.
    """
    rank: Column = F.col("chrom")
    if references is not None:
        alignments = alignments.join(small(references.select(F.col("name").alias("chrom"), "ref_id")), "chrom", "left")
        rank = F.col("ref_id")
    keys = [rank.asc_nulls_last(), F.col("pos").asc(), S.has_flag("flag", S.REVERSE).asc(), F.col("file_id").asc(), F.col("ordinal").asc()]
    return alignments.orderBy(*keys)


def numbered(rows: DataFrame, order: list[Column | str], within: list[str] = [], name: str = "num") -> DataFrame:  # noqa: B006
    """Rows with their number, from 0, in an order: of all rows, or of those that agree in ``within``.

    Rows are sorted into ranges; a row's number is its place in its range after all rows of the ranges before.  No task
    holds more than a range, even where one group has most of the rows.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    # Within a range this id counts the rows in their order; its high bits are the range.
    ranged = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(ranged.withColumn("_part", F.shiftright("_id", 33)), "ranges")
    cells = placed.groupBy(*within, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    ahead = small(cells.withColumn("_ahead", F.sum("_n").over(W.partitionBy(*within).orderBy("_part")) - F.col("_n")).drop("_n"))
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*within, "_part"]])
    met = placed.alias("a").join(ahead.alias("b"), same)
    return met.select(*[F.col(f"a.`{c}`") for c in rows.columns], (F.col("_id") - F.col("_first") + F.col("_ahead")).alias(name))


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows in sorted ranges, written: ``_part`` numbers the ranges and ``_id`` rises with the order within and over them."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialise(sorted_rows.withColumn("_part", F.shiftright("_id", 33)), "ranges")


def with_previous(rows: DataFrame, columns: list[str], within: list[str], order: list[str]) -> DataFrame:
    """Adds ``prev_<column>``, the value in the row before among those that agree in ``within``, and ``prev_exists``.

    Rows are sorted into ranges and look back within their range; the first of a range looks at the last row of the one
    before.  So no task holds more than a range, even where one group has most of the rows.
    """
    placed = ranged(rows, [*within, *order])
    back = W.partitionBy("_part").orderBy("_id")
    held = F.struct(*[F.col(c).alias(f"w{i}") for i, c in enumerate(within)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    inside = placed.withColumn("_held", held).withColumn("_prev", F.lag("_held").over(back))
    # One row a range: its last row, which the next range that has rows begins with.
    ends = placed.groupBy("_part").agg(F.max_by(held, "_id").alias("_last"), F.min("_id").alias("_id"))
    before = small(ends.withColumn("_before", F.lag("_last").over(W.orderBy("_part"))).select("_id", "_before"))
    met = inside.join(before, "_id", "left").withColumn("_prev", F.coalesce("_prev", "_before"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_prev.w{i}")) for i, c in enumerate(within)], F.col("_prev").isNotNull())
    out = met.withColumn("prev_exists", same)
    return out.withColumns({f"prev_{c}": F.when(F.col("prev_exists"), F.col(f"_prev.c{i}")) for i, c in enumerate(columns)}).drop("_held", "_prev", "_before")


def running_sum(placed: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` up to and with each row over the ranges of ``ranged``."""
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, 0))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("_total"))
    ahead = small(totals.withColumn("_ahead", F.sum("_total").over(W.orderBy("_part")) - F.col("_total")).select("_part", "_ahead"))
    return placed.join(ahead, "_part").withColumn(name, inside + F.col("_ahead")).drop("_ahead")


def coordinate_rank(alignments: DataFrame) -> DataFrame:
    """(file_id, ordinal, rank): the place of each record in coordinate order, from 1."""
    order = [F.col("chrom").asc_nulls_last(), "pos", S.has_flag("flag", S.REVERSE).cast("int"), "file_id", "ordinal"]
    return numbered(alignments.select("file_id", "ordinal", "chrom", "pos", "flag"), order).select("file_id", "ordinal", (F.col("num") + 1).alias("rank"))
