"""Assembly statistics per cell from contigs (cell_id, len, gc, acgt, ns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

THRESHOLDS = (0, 1000, 5000, 10000, 25000, 50000)


def contigs_of(sequences: DataFrame) -> DataFrame:
    """Lengths and base counts of (cell_id, seq); letters count in either case."""
    up = F.upper("seq")
    n = lambda letters: F.length(up) - F.length(F.translate(up, letters, ""))
    return sequences.select("cell_id", F.length("seq").cast("long").alias("len"), n("GC").cast("long").alias("gc"), n("ACGT").cast("long").alias("acgt"), n("N").cast("long").alias("ns"))


def assembly_stats(contigs: DataFrame, min_contig: int = 500) -> DataFrame:
    """One row per cell; metrics of contigs of ``min_contig`` or more are null where a cell has none.

    Nx is the length at which contigs from the longest down hold x % of the bases, Lx how many contigs that takes.
    Equal lengths are summed first, so that the running sums go over distinct lengths.
    """
    size = F.col("len")
    counts = [F.sum((size >= t).cast("long")).alias(f"contigs_{t}") for t in THRESHOLDS] + [F.coalesce(F.sum(F.when(size >= t, size)), F.lit(0)).alias(f"total_{t}") for t in THRESHOLDS]
    kept = size >= min_contig
    part = lambda c: F.sum(F.when(kept, F.col(c)))
    main = [F.sum(kept.cast("long")).alias("contigs"), F.max(F.when(kept, size)).alias("largest"), F.coalesce(part("len"), F.lit(0)).alias("total"), F.coalesce(part("ns"), F.lit(0)).alias("n_bases")]
    ratio = [F.round(F.sum(F.when(kept, size * size)) / F.nullif(part("len"), F.lit(0)), 6).alias("aun"), F.round(part("gc") * 100 / F.nullif(part("acgt"), F.lit(0)), 6).alias("gc_percent"), F.round(part("ns") * 100000 / F.nullif(part("len"), F.lit(0)), 6).alias("ns_per_100kbp")]
    base = contigs.groupBy("cell_id").agg(*counts, *main, *ratio)
    lengths = contigs.where(kept).groupBy("cell_id", "len").agg(F.count("*").alias("k"))
    w = W.partitionBy("cell_id").orderBy(F.desc("len"))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(size * F.col("k")).over(W.partitionBy("cell_id"))
    # Contigs of this length that are needed: as many as carry the running sum to the share.
    rows = lengths.withColumn("total", total).withColumn("before", F.sum(size * F.col("k")).over(run) - size * F.col("k")).withColumn("placed", F.sum("k").over(run) - F.col("k"))
    for x in (50, 90):
        need = F.ceil((F.col("total") * x / 100 - F.col("before")) / size)
        rows = rows.withColumn(f"l{x}", F.when((need <= F.col("k")), F.col("placed") + F.greatest(need, F.lit(1)))).withColumn(f"n{x}", F.when(need <= F.col("k"), size))
    nx = rows.groupBy("cell_id").agg(*[F.max(f"n{x}").alias(f"n{x}") for x in (50, 90)], *[F.min(f"l{x}").cast("long").alias(f"l{x}") for x in (50, 90)])
    return base.join(nx, "cell_id", "left")
