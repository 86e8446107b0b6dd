"""Reads and molecules of each feature and cell, without a row for each pair of a read and a feature.

Features that lie close together form a group, and reads meet groups, not features: a read comes once for each group that
it reaches into, however many features stand there.  Within a group features are answered from sorted places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.filters import small
from cytoloom.operators.intervals import feature_umis, overlaps
from cytoloom.operators.umis import CODE_BITS, directional_umis
from cytoloom.scratch import materialise

#: Features of up to 2^NARROW bases are grouped by starts that far apart; longer ones by 4, 16 ... times as much.
NARROW = 10
#: Reads of a group that a task holds, about; a group with more is parted by cells.
GROUP_READS = 200_000
#: Counts of features by cells that are made at once.
CELLS = 1 << 22
#: Added to codes that are like no other, so that they stay apart and below 0.
NONE = -(1 << 62)
GROUP = ["chrom", "_class", "_node"]


def _genes(features: DataFrame) -> DataFrame:
    """The features with their group, and as _n in how many intervals each of them comes."""
    width = F.greatest(F.lit(NARROW), F.ceil(F.log2(F.col("end") - F.col("start")) / 2) * 2).cast("int")
    genes = features.select("gene_id", "chrom", "start", "end").where("end > start").withColumn("_class", width).withColumn("_node", F.expr("shiftright(start, _class)"))
    return materialise(genes.withColumn("_n", F.count("*").over(W.partitionBy("gene_id"))), "features")


def _reads(alignments: DataFrame) -> DataFrame:
    return alignments.where(~S.has_flag("flag", S.UNMAPPED)).withColumnsRenamed({"pos": "start", "end_pos": "end"})


def _by_group(reads: DataFrame, genes: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``kernel`` makes of the reads and the features of each group, or of some of the cells in a crowded one.

    The reads of one cell in one group are not parted.
    """
    extents = genes.groupBy(*GROUP).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    met = materialise(overlaps(reads, extents).drop("r_start", "r_end"), "met")
    parts = small(met.groupBy(*GROUP).agg(F.ceil(F.count("*") / GROUP_READS).cast("int").alias("_parts")))
    left = met.join(parts, GROUP).withColumn("_part", F.pmod(F.xxhash64("cell_id"), F.col("_parts")).cast("int")).drop("_parts")
    right = genes.drop("_n").join(parts, GROUP).withColumn("_part", F.explode(F.expr("sequence(0, _parts - 1)"))).drop("_parts")
    return left.groupBy(*GROUP, "_part").cogroup(right.groupBy(*GROUP, "_part")).applyInArrow(kernel, schema)


def _by_cell(cells: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """One number for each cell and place, in the order of both."""
    return cells * size + places


def _rows(genes: pa.Table, names: pa.Array, counts: Iterator[tuple[np.ndarray, np.ndarray]], field: str) -> pa.Table:
    """(gene_id, cell_id, field) of the counts over 0; each part is (numbers of features, counts of these by cells)."""
    gene, cell, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for which, table in counts:
        at, c = np.nonzero(table)
        gene.append(which[at])
        cell.append(c)
        n.append(table[at, c])
    gene, cell, n = (np.concatenate(x) for x in (gene, cell, n))
    return pa.table({"gene_id": genes["gene_id"].combine_chunks().take(pa.array(gene)), "cell_id": names.take(pa.array(cell)), field: pa.array(n.astype(np.int64))})


def _coded(reads: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Names of the cells, and cell, start and end of each read."""
    cells = reads["cell_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    return cells.dictionary, cells.indices.to_numpy(zero_copy_only=False).astype(np.int64), reads["start"].to_numpy(), reads["end"].to_numpy()


def feature_reads(alignments: DataFrame, features: DataFrame) -> DataFrame:
    """(gene_id, cell_id, n_reads): mapped records that overlap each feature; a name of several intervals has their sum.

    What overlaps [start, end) begins before its end, less what ends up to its start; both are looked up in sorted places.
    """

    def kernel(reads: pa.Table, genes: pa.Table) -> pa.Table:
        def counts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = max(1, CELLS // max(1, len(names)))
            for i in range(0, len(low), step):
                a, b = high[i : i + step, None], low[i : i + step, None]
                yield np.arange(i, i + len(a)), np.searchsorted(begins, _by_cell(every, a, size)) - np.searchsorted(ends, _by_cell(every, b, size), "right")

        if not len(reads) or not len(genes):
            return _rows(genes, pa.array([], pa.string()), iter(()), "n_reads")
        names, cell, start, end = _coded(reads)
        low, high = genes["start"].to_numpy(), genes["end"].to_numpy()
        first = int(low.min())
        size = int(high.max()) - first + 2
        low, high = low - first, high - first
        begins = np.sort(_by_cell(cell, np.maximum(start - first, 0), size))
        ends = np.sort(_by_cell(cell, np.minimum(end - first, size - 1), size))
        every = np.arange(len(names))
        return _rows(genes, names, counts(), "n_reads")

    genes = _genes(features)
    found = _by_group(_reads(alignments).select("chrom", "start", "end", "cell_id"), genes, kernel, "gene_id string, cell_id string, n_reads long")
    if genes.where("_n > 1").isEmpty():
        return found
    return found.groupBy("gene_id", "cell_id").agg(F.sum("n_reads").alias("n_reads"))


def molecules_upto(cells: list[int], codes: list[int], bits: int = CODE_BITS) -> np.ndarray:
    """After each read of its cell, how many UMIs so far have no like UMI of higher count; reads of a cell stand together.

    Codes that differ in a bit are alike, of equal counts the higher code wins, and codes below 0 are like no other.
    A read makes one UMI stronger, so only this one may rise and only those like it may fall.
    """
    flips, out, held = [1 << b for b in range(bits)], np.zeros(len(codes), np.int64), None
    seen: dict[int, int] = {}
    beaten: set[int] = set()
    standing = 0
    for i, (cell, code) in enumerate(zip(cells, codes)):
        if cell != held:
            held, seen, beaten, standing = cell, {}, set(), 0
        n = seen.get(code, 0) + 1
        seen[code] = n
        near = [code ^ f for f in flips if code ^ f in seen] if code >= 0 else ()
        if not near:
            standing += n == 1
        else:
            loses = False
            for other in near:
                if (seen[other], other) > (n, code):
                    loses = True
                elif other not in beaten:
                    beaten.add(other)
                    standing -= 1
            if n == 1:
                standing += not loses
                if loses:
                    beaten.add(code)
            elif not loses and code in beaten:
                beaten.remove(code)
                standing += 1
        out[i] = standing
    return out


def feature_molecules(alignments: DataFrame, features: DataFrame, bits: int = CODE_BITS) -> DataFrame:
    """(gene_id, cell_id, n_umis): as ``directional_umis`` of ``feature_umis``, for UMIs of one length of bits / 2 bases.

    Features that begin together are parts of the longest of them, so the molecules are counted once along its reads, and
    each feature takes the number at its end.  A name of several intervals has molecules in common there; its rows are
    counted from pairs, as are those without a name.  UMIs of a null cell are like no other.
    """

    def kernel(reads: pa.Table, genes: pa.Table) -> pa.Table:
        def counts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for begin in np.unique(low):
                which = np.flatnonzero(low == begin)
                use = np.flatnonzero((end > begin) & (start < high[which].max()))
                use = use[np.lexsort((start[use], cell[use]))]
                if not len(use):
                    continue
                upto = molecules_upto(cell[use].tolist(), code[use].tolist(), bits)
                base = min(int(begin), int(start[use].min()))
                size = int(high[which].max()) - base + 1
                places, every = _by_cell(cell[use], start[use] - base, size), np.arange(len(names))
                before = np.searchsorted(cell[use], every)
                step = max(1, CELLS // len(names))
                for i in range(0, len(which), step):
                    some = which[i : i + step]
                    stop = np.searchsorted(places, _by_cell(every, high[some, None] - base, size))
                    yield some, np.where(stop > before, upto[np.maximum(stop - 1, 0)], 0)

        if not len(reads) or not len(genes):
            return _rows(genes, pa.array([], pa.string()), iter(()), "n_umis")
        names, cell, start, end = _coded(reads)
        low, high = genes["start"].to_numpy(), genes["end"].to_numpy()
        other = reads["other"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        known = reads["code"].combine_chunks()
        code = np.where(known.is_valid().to_numpy(zero_copy_only=False), known.fill_null(0).to_numpy(zero_copy_only=False), -1 - other.astype(np.int64))
        nameless = reads["cell_id"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        code[nameless & (code >= 0)] += NONE  # as in a join, where no null equals another
        return _rows(genes, names, counts(), "n_umis")

    genes = _genes(features)
    coded = _reads(alignments).withColumn("code", S.umi_code("umi")).select("chrom", "start", "end", "cell_id", "code", F.when(F.col("code").isNull(), F.col("umi")).alias("other"))
    found = _by_group(coded, genes.where("_n = 1 and gene_id is not null"), kernel, "gene_id string, cell_id string, n_umis long")
    several = genes.where("_n > 1 or gene_id is null")
    if several.isEmpty():
        return found
    return found.unionByName(directional_umis(feature_umis(alignments, several), ["gene_id", "cell_id"], bits=bits))
