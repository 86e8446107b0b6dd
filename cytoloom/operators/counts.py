"""Per-cell counts of reads, chromosomes, features and taxa."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.filters import unique_mappers
from cytoloom.operators.layout import numbered, ranged, running_sum
from cytoloom.scratch import materialise


def cell_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy("cell_id").agg(F.count("*").alias("n_reads"))


def drop_repeated_starts(alignments: DataFrame) -> DataFrame:
    """Leaves out a record that starts where the record before it in its cell and chromosome does."""
    before = F.lag("pos").over(W.partitionBy("file_id", "cell_id", "chrom").orderBy("ordinal"))
    return alignments.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col("pos"))).drop("_before")


def count_chrom(alignments: DataFrame, remove_multimappers: bool = False, min_matching: int = 0, remove_duplicates: bool = False) -> DataFrame:
    """cell_id, chrom, n_reads of mapped records; where the chromosome is null, the records that are unmapped or match too little."""
    rows = unique_mappers(alignments) if remove_multimappers else alignments
    good = ~S.has_flag("flag", S.UNMAPPED) & (S.matched_bases("cigar") >= min_matching)
    rows = rows.withColumn("chrom", F.when(good, F.col("chrom")))
    if remove_duplicates:
        rows = drop_repeated_starts(rows.where("chrom is not null")).unionByName(rows.where("chrom is null"))
    return rows.groupBy("cell_id", "chrom").agg(F.count("*").alias("n_reads"))


def ref_composition(alignments: DataFrame) -> DataFrame:
    """Mapped records by cell and reference."""
    return alignments.where(~S.has_flag("flag", S.UNMAPPED)).groupBy("cell_id", "chrom").agg(F.count("*").alias("n_reads"))


def taxon_counts(classified: DataFrame) -> DataFrame:
    """Read pairs by cell and taxon from (cell_id, taxid); taxon 0 is the unclassified ones."""
    return classified.groupBy("cell_id", F.coalesce("taxid", F.lit(0)).alias("taxid")).agg(F.count("*").alias("n_pairs"))


def dense_triplets(counts: DataFrame) -> DataFrame:
    """(row, col, cnt) with repeated triplets summed; rows and columns are numbered in the order of their names.

    The names are numbered in small tables of distinct cells and features, not over the triplets.
    """
    summed = counts.groupBy("cell_id", "feature").agg(F.sum("cnt").alias("cnt"))
    summed = materialise(summed, "triplets")
    number = lambda c: numbered(summed.select(c).distinct(), [c], name=f"{c}_no")
    return summed.join(number("cell_id"), "cell_id").join(number("feature"), "feature").select(F.col("cell_id_no").alias("row"), F.col("feature_no").alias("col"), "cnt")


def chemistry_vote(hits: DataFrame) -> DataFrame:
    """The kit with the largest share of reads that match, from (kit, matched); ties go to the name that comes first."""
    shares = hits.groupBy("kit").agg((F.sum(F.col("matched").cast("int")) / F.count("*")).alias("share"))
    return shares.orderBy(F.desc("share"), "kit").limit(1)


def read_quality(reads: DataFrame) -> DataFrame:
    """Per cell: mates, mean length, per cent GC and N, and mean base quality (Phred + 33); null where a cell has no bases."""
    mates = reads.select("cell_id", F.explode(F.array(F.struct(F.col("r1").alias("s"), F.col("q1").alias("q")), F.struct(F.col("r2").alias("s"), F.col("q2").alias("q")))).alias("m")).select("cell_id", "m.s", "m.q")
    n = lambda letters: F.length("s") - F.length(F.translate("s", letters, ""))
    total = F.aggregate(F.transform(F.split("q", ""), lambda c: F.ascii(c) - 33), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = mates.where(F.length("s") > 0).select("cell_id", F.length("s").alias("len"), n("GC").alias("gc"), n("N").alias("ns"), total.alias("quality"))
    per = lambda c, scale: F.round(F.sum(c) * scale / F.nullif(F.sum("len"), F.lit(0)), 6)
    return sums.groupBy("cell_id").agg(F.count("*").alias("n_mates"), F.round(F.avg("len"), 6).alias("mean_length"), per("gc", 100).alias("gc_percent"), per("ns", 100).alias("n_percent"), per("quality", 1).alias("mean_quality"))


def csr_blocks(triplets: DataFrame, block_rows: int = 1_000) -> DataFrame:
    """(block, first_row, n_rows, indptr, indices, data): a sparse matrix by rows, in blocks of ``block_rows`` rows.

    ``triplets`` are (row, col, cnt) with every row from 0 on, as ``dense_triplets`` numbers them.  ``indptr`` counts
    the entries of the whole matrix before each row and behind the last, so blocks follow each other; columns rise within a
    row.  The sums run over ranges of rows, and no array is longer than a block.
    """
    block = F.floor(F.col("row") / block_rows)
    stops = running_sum(ranged(triplets.groupBy("row").agg(F.count("*").alias("_n")), ["row"]), "_n", "_stop")
    ptr = stops.groupBy(block.alias("block")).agg(F.min(F.col("_stop") - F.col("_n")).alias("_first"), F.array_sort(F.collect_list("_stop")).alias("_stops"))
    entries = triplets.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("row", "col", "cnt"))).alias("_e"))
    field = lambda c: F.transform("_e", lambda x: x[c])
    return ptr.join(entries, "block").select("block", (F.col("block") * block_rows).alias("first_row"), F.size("_stops").alias("n_rows"), F.concat(F.array("_first"), F.col("_stops")).alias("indptr"), field("col").alias("indices"), field("cnt").alias("data"))


#: What is summed by position: mates that reach it, their qualities, and bases of each kind; anything but ACGT counts as N.
POSITION = ("n", "quality", "a", "c", "g", "t", "other")


def position_report(reads: DataFrame) -> DataFrame:
    """(cell_id, mate, pos, n, quality, a, c, g, t, other): sums over the mates of a cell by 0-based position.

    A task adds whole batches up as arrays and hands on one row for each cell, mate and position it has seen.  Qualities
    are Phred + 33; a mate that is null has no positions.
    """
    schema = pa.schema([("cell_id", pa.string()), ("mate", pa.int32()), ("pos", pa.int32()), *[(c, pa.int64()) for c in POSITION]])
    kinds = np.full(256, 6)
    for i, base in enumerate("ACGT", 2):
        kinds[ord(base)] = i

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("cell_id").dictionary_encode(null_encoding="encode")
            code = cells.indices.to_numpy()
            for mate in (1, 2):
                bases, quals = ([x or "" for x in batch.column(f"{c}{mate}").to_pylist()] for c in "rq")
                size = np.array([len(x) for x in bases], np.int64)
                width = int(size.max(initial=0))
                if not width:
                    continue
                row = np.repeat(np.arange(len(bases)), size)
                at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                letters = np.frombuffer("".join(bases).encode("latin-1", "replace"), np.uint8)
                quality = np.frombuffer("".join(q.ljust(n, "!")[:n] for q, n in zip(quals, size.tolist())).encode("latin-1", "replace"), np.uint8).astype(np.int64) - 33
                key, n = code[row].astype(np.int64) * width + at, len(cells.dictionary) * width
                table = np.zeros((len(POSITION), n), np.int64)
                table[0], table[1] = np.bincount(key, minlength=n), np.bincount(key, quality, n).astype(np.int64)
                kind = kinds[letters]
                for i in range(2, len(POSITION)):
                    table[i] = np.bincount(key[kind == i], minlength=n)
                seen = np.flatnonzero(table[0])
                names = cells.dictionary.take(pa.array(seen // width))
                yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.full(len(seen), mate, np.int32)), pa.array((seen % width).astype(np.int32)), *[pa.array(x[seen]) for x in table]], schema=schema)

    parts = reads.select("cell_id", "r1", "r2", "q1", "q2").mapInArrow(sums, "cell_id string, mate int, pos int, " + ", ".join(f"{c} long" for c in POSITION))
    return parts.groupBy("cell_id", "mate", "pos").agg(*[F.sum(c).alias(c) for c in POSITION])


def duplication_levels(reads: DataFrame) -> DataFrame:
    """(cell_id, copies, n_sequences): how many different pairs of mates a cell has once, twice and so on.

    Pairs are told apart by two hashes of 64 bits, so a row of two numbers is shuffled for each, not the bases.
    """
    key = [F.xxhash64("r1", "r2").alias("h1"), F.xxhash64("r2", F.lit("\t"), "r1").alias("h2")]
    copies = reads.select("cell_id", *key).groupBy("cell_id", "h1", "h2").agg(F.count("*").alias("copies"))
    return copies.groupBy("cell_id", "copies").agg(F.count("*").alias("n_sequences"))
