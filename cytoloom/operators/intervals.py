"""Overlap joins, coverage and tracks on genomic intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.filters import small
from cytoloom.scratch import materialise

#: Narrowest bins of an overlap join; wider ones are 4, 16, 64 ... times as wide.
LEAST_BITS = 6


def _bins(start: str, end: str, width: int) -> Column:
    return F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))


def overlaps(left: DataFrame, right: DataFrame, least_bits: int = LEAST_BITS) -> DataFrame:
    """All pairs of rows on one chromosome whose [start, end) overlap, by an equi-join on bins.

    An interval of the right side lies in at most two of the narrowest bins that are as wide as itself, so what meets
    in a bin is not much more than what overlaps.  The left side is looked up in the bins of each width that occurs.  A
    pair that shares several bins is kept in the first of them only, so no distinct is needed.  The right side's
    columns are chrom, start and end as well and come out as r_start and r_end; a small one is broadcast.
    """
    length = F.col("r_end") - F.col("r_start")
    bits = F.greatest(F.lit(least_bits), F.ceil(F.log2(length) / 2) * 2).cast("int")
    b = right.where("end > start").withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumn("_bits", bits)
    b = b.withColumn("_bin", F.explode(F.expr("sequence(shiftright(r_start, _bits), shiftright(r_end - 1, _bits))")))
    b = small(b)
    widths = sorted(r[0] for r in b.select("_bits").distinct().collect())  # 30 at most
    each = F.flatten(F.array(*[F.transform(F.expr(f"sequence(shiftright(start, {w}), shiftright(end - 1, {w}))"), lambda x: F.struct(F.lit(w).alias("_bits"), x.alias("_bin"))) for w in widths])) if widths else F.array().cast("array<struct<_bits:int,_bin:bigint>>")  # noqa: B023
    a = left.where("end > start").withColumn("_b", F.explode(each)).select(*left.columns, "_b._bits", "_b._bin")
    met = a.join(b, ["chrom", "_bits", "_bin"])
    first = F.expr("shiftright(greatest(start, r_start), _bits)")
    return met.where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("_bin") == first)).drop("_bin", "_bits")


def feature_umis(alignments: DataFrame, features: DataFrame, shift_start: bool = False) -> DataFrame:
    """(gene_id, cell_id, umi, cnt) of mapped records that overlap a feature, each as often as features it meets.

    ``shift_start`` leaves out the first base of a feature, as a reader that takes 1-based starts for 0-based ones does.
    """
    reads = alignments.where(~S.has_flag("flag", S.UNMAPPED)).select("cell_id", "umi", "chrom", F.col("pos").alias("start"), F.col("end_pos").alias("end"))
    genes = features.select("gene_id", "chrom", (F.col("start") + int(shift_start)).alias("start"), "end")
    return overlaps(reads, genes).groupBy("gene_id", "cell_id", "umi").agg(F.count("*").alias("cnt"))


def fragments(alignments: DataFrame) -> DataFrame:
    """Mapped records as BED rows with count 1."""
    return alignments.where(~S.has_flag("flag", S.UNMAPPED)).select("chrom", F.col("pos").alias("start"), F.col("end_pos").alias("end"), "cell_id", F.lit(1).alias("cnt"), F.lit("").alias("umi"))


def depth_runs(alignments: DataFrame) -> DataFrame:
    """(cell_id, chrom, start, len, depth) of every run of equal depth over 0.

    Starts and ends are summed by place before any window, so a place that many records share is one row.
    """
    rows = alignments.where(~S.has_flag("flag", S.UNMAPPED) & (F.col("end_pos") > F.col("pos")))
    ends = rows.select("cell_id", "chrom", F.explode(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_pos").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("cell_id", "chrom", F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = W.partitionBy("cell_id", "chrom").orderBy("start")
    runs = steps.withColumn("depth", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("len", F.lead("start").over(w) - F.col("start"))
    return runs.where("depth > 0").select("cell_id", "chrom", "start", "len", "depth")


def aligned_coverage(alignments: DataFrame) -> DataFrame:
    """Per cell and reference: places covered, aligned bases and records."""
    rows = alignments.where(~S.has_flag("flag", S.UNMAPPED))
    sums = rows.groupBy("cell_id", "chrom").agg(F.sum(F.col("end_pos") - F.col("pos")).alias("sumof_aligned_bases"), F.count("*").alias("countof_alignments"))
    union = depth_runs(alignments).groupBy("cell_id", "chrom").agg(F.sum("len").alias("union_aligned_bases"))
    return sums.join(union, ["cell_id", "chrom"], "left").withColumn("union_aligned_bases", F.coalesce("union_aligned_bases", F.lit(0)).cast("long"))


def coverage_rle(alignments: DataFrame) -> DataFrame:
    """The runs of a cell and reference as text, start:depth:len by start."""
    run = F.struct("start", F.concat_ws(":", "start", "depth", "len").alias("t"))
    return depth_runs(alignments).groupBy("cell_id", "chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(run)), lambda x: x["t"]), ",").alias("rle"))


def binned_coverage(alignments: DataFrame, width: int = 50) -> DataFrame:
    """(chrom, start, end, bases): bins of ``width`` by aligned bases, neighbours of equal bases merged, empty bins left out."""
    blocks = alignments.select("chrom", F.explode(S.aligned_blocks("pos", "cigar")).alias("b")).select("chrom", F.col("b.start").alias("start"), F.col("b.end").alias("end")).where("end > start")
    each = blocks.withColumn("bin", F.explode(_bins("start", "end", width)))
    part = F.least(F.col("end"), (F.col("bin") + 1) * width) - F.greatest(F.col("start"), F.col("bin") * width)
    bins = each.groupBy("chrom", "bin").agg(F.sum(part).alias("bases"))
    w = W.partitionBy("chrom").orderBy("bin")
    new = F.when((F.lag("bin").over(w) == F.col("bin") - 1) & (F.lag("bases").over(w) == F.col("bases")), 0).otherwise(1)
    runs = bins.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy("chrom", "_run", "bases").agg((F.min("bin") * width).alias("start"), ((F.max("bin") + 1) * width).alias("end")).select("chrom", "start", "end", "bases")


def track_values(bins: DataFrame, width: int = 50, scale: float = 1.0) -> DataFrame:
    """bedGraph rows: bases over the bin width, scaled, in single precision."""
    return bins.select("chrom", "start", "end", (F.col("bases") / width * scale).cast("float").alias("value"))


def zoom_levels(runs: DataFrame, widths: list[int], value: str = "bases") -> DataFrame:
    """(level, chrom, start, end, covered, least, most, total, squares) of runs (chrom, start, end, value) at several widths.

    A row summarises one bin: places with a value, the smallest and largest of the values, their sum and the sum of their
    squares over all places.  The runs are read once, for the first width; each next one, a multiple of the one before, is
    made of the summaries below it.
    """
    if any(b % a for a, b in zip(widths, widths[1:])):
        raise ValueError("each width must be a multiple of the one before")
    v, places = F.col(value), F.least(F.col("end"), (F.col("bin") + 1) * widths[0]) - F.greatest(F.col("start"), F.col("bin") * widths[0])
    level = runs.where("end > start").withColumn("bin", F.explode(_bins("start", "end", widths[0]))).groupBy("chrom", "bin")
    level = level.agg(F.sum(places).alias("covered"), F.min(v).alias("least"), F.max(v).alias("most"), F.sum(v * places).alias("total"), F.sum(v * v * places).alias("squares"))
    out, parts = None, ["covered", "least", "most", "total", "squares"]
    for number, width in enumerate(widths):
        if number:
            up = level.groupBy("chrom", F.floor(F.col("bin") / (width // widths[number - 1])).alias("bin"))
            level = up.agg(F.sum("covered").alias("covered"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
        level = materialise(level, "zoom")
        rows = level.select(F.lit(number).alias("level"), "chrom", (F.col("bin") * width).alias("start"), ((F.col("bin") + 1) * width).alias("end"), *parts)
        out = rows if out is None else out.unionByName(rows)
    return out
