"""Assigning reads to cells by barcode, and trimming reads that run into each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.filters import small


def neighbours(seq: Column, mismatches: int) -> Column:
    """The sequence and all that differ from it in up to ``mismatches`` (0 or 1) bases, N included."""
    if not mismatches:
        return F.array(seq)
    one = F.flatten(F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.transform(F.array(*map(F.lit, "ACGTN")), lambda b: F.concat(F.substr(seq, F.lit(1), i - 1), b, F.substr(seq, i + 1)))))
    return F.array_distinct(F.concat(F.array(seq), one))


def nearest_barcode(tags: DataFrame, whitelist: DataFrame, mismatches: int = 1, pool: int | None = None) -> DataFrame:
    """Adds name, idx and distance of the closest barcode to rows with ``tag``; null where none is within ``mismatches``.

    Equal distances go to the smallest idx.  The whitelist is spread to its neighbourhood, in which each spelling keeps
    its best barcode, and looked up by an equi-join, so work does not grow with reads times barcodes.
    """
    wl = whitelist if pool is None else whitelist.where(F.col("pool") == pool)
    near = wl.select("idx", "name", "seq", F.explode(neighbours(F.col("seq"), mismatches)).alias("tag"))
    near = near.withColumn("distance", S.hamming("seq", "tag")).groupBy("tag").agg(F.min(F.struct("distance", "idx", "name")).alias("m")).where(F.col("m.distance") <= mismatches)
    return tags.join(small(near), "tag", "left").select(*tags.columns, F.col("m.name").alias("name"), F.col("m.idx").alias("idx"), F.col("m.distance").alias("distance"))


def nearest_long_barcode(tags: DataFrame, whitelist: DataFrame) -> DataFrame:
    """The same for long barcodes and one mismatch: one half must agree exactly, so halves are joined and pairs verified."""
    halves = lambda c: F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substr(F.col(c), F.lit(1), F.floor(F.length(c) / 2).cast("int")).alias("part")), F.struct(F.lit(1).alias("side"), F.substr(F.col(c), F.floor(F.length(c) / 2).cast("int") + 1).alias("part"))))
    wl = whitelist.select("idx", "name", "seq", halves("seq").alias("h"))
    met = tags.select("tag").distinct().withColumn("h", halves("tag")).join(small(wl), "h").withColumn("distance", S.hamming("seq", "tag")).where("distance <= 1")
    best = met.groupBy("tag").agg(F.min(F.struct("distance", "idx", "name")).alias("m"))
    return tags.join(best, "tag", "left").select(*tags.columns, F.col("m.name").alias("name"), F.col("m.idx").alias("idx"), F.col("m.distance").alias("distance"))


def edit_distance_barcode(windows: DataFrame, whitelist: DataFrame, most: int = 1) -> DataFrame:
    """Closest barcode by edit distance for rows with ``tag``.

    Of most + 1 pieces of the barcode one stands in the tag unchanged, at most ``most`` places from its own; pieces are
    joined and the pairs verified.
    """
    def pieces(c: Column) -> Column:
        width = F.floor(F.length(c) / (most + 1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.struct(i.alias("i"), F.when(i == most, F.substr(c, i * width + 1)).otherwise(F.substr(c, i * width + 1, width)).alias("part")))

    wl = whitelist.select("idx", "name", "seq", F.explode(pieces(F.col("seq"))).alias("p")).select("idx", "name", "seq", F.col("p.part").alias("part"))
    widths = [r[0] for r in wl.select(F.length("part")).distinct().collect()]  # as many as barcode lengths at most
    parts = F.flatten(F.array(*[S.kmers("tag", k) for k in widths])) if widths else F.array().cast("array<string>")
    found = windows.select("tag").distinct().withColumn("part", F.explode(F.array_distinct(parts))).join(small(wl), "part")
    met = found.withColumn("distance", F.levenshtein("tag", "seq")).where(F.col("distance") <= most)
    best = met.groupBy("tag").agg(F.min(F.struct("distance", "idx", "name")).alias("m"))
    return windows.join(best, "tag", "left").select(*windows.columns, F.col("m.name").alias("name"), F.col("m.idx").alias("idx"), F.col("m.distance").alias("distance"))


def debarcode(pairs: DataFrame, whitelist: DataFrame, places: list[tuple[int, int]], width: int = 8, most: int = 1, library: str = "") -> DataFrame:
    """Reads with a cell name from barcodes in R2 at (pool, 0-based place); pairs with a barcode too far from any are left out.

    The total distance over the pools must be at most ``most``.  R2 loses what stands up to the end of the last barcode;
    a UMI that the pairs come with stays.
    """
    from cytoloom.operators.chemistry import Chemistry, Pool, assign_cells

    kit = Chemistry("", tuple(Pool(pool, (at,), width) for pool, at in places), "r2", None, most, min(most, 1))
    held = pairs.withColumn("_umi", F.col("umi") if "umi" in pairs.columns else F.lit(""))
    return assign_cells(held, whitelist, kit, library).where("accepted").withColumn("umi", F.col("_umi")).drop("_umi", "distance", "accepted")


#: Bases of a probe, and of its first part, most of which must agree before the rest counts.
PROBE, TIP = 16, 8
#: Letters of a batch that are compared at once.
CELLS = 1 << 22


def _letters(texts: list[str], width: int) -> np.ndarray:
    """A row of bytes for each text, cut or filled up with zeros to ``width``."""
    return np.frombuffer(b"".join(t.encode()[:width].ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)


def probe_places(reads: list[str], probes: list[str]) -> np.ndarray:
    """For each read the place where its probe of 16 bases stands, whole or cut off by the end of the read; -1 if nowhere.

    Every place gets a class, and the lowest place of the best class counts.  Class 0 holds places with 15 or more
    agreeing bases, class 1 the last of all places if 14 agree there; both have 16 more bases behind the probe and six
    agreeing ones among its first eight.  Class 2 holds places 9 to 16 bases before the end with at most one
    disagreement in what is seen and the same six, class 3 those under 8 bases before the end with at most one
    disagreement.  N agrees with nothing.
    """
    if not reads:
        return np.zeros(0, np.int64)
    size = np.array([len(r) for r in reads])
    width = max(1, int(size.max()))
    letters, probe = _letters(reads, width + PROBE), _letters(probes, PROBE)
    same = np.zeros((2, len(reads), width), np.uint8)
    for j in range(PROBE):
        base = probe[:, j : j + 1]
        same[j // TIP] += (letters[:, j : j + width] == base) & (base != ord("N"))
    tip, total = same[0] > 5, same[0] + same[1]
    place = np.arange(width)
    left = size[:, None] - place
    whole, missed = tip & (left >= 2 * PROBE), np.minimum(left, PROBE) - total
    last = width - 1 - np.argmax(whole[:, ::-1], 1)[:, None]
    classes = [whole & (total > 14), whole & (place == last) & (total > 13), tip & (left > TIP) & (left <= PROBE) & (missed < 2), (left > 0) & (left < TIP) & (missed < 2)]
    rank = np.select(classes, range(4), 4)
    best = np.argmin(rank, 1)
    return np.where(np.take_along_axis(rank, best[:, None], 1)[:, 0] < 4, best, -1)


def mate_overlap(r1: list[str], r2: list[str], barcode_length: int) -> np.ndarray:
    """Bases that both mates have read.  Two probes of the second mate are looked for in the first: one that ends with the
    barcode's length, and the last one; the place farther from the end of r1 counts, of equal ones that of the last probe."""
    flipped = [x.translate(str.maketrans("ACGT", "TGCA"))[::-1] for x in r2]
    n1, n2 = (np.array([len(x) for x in side], np.int64) for side in (r1, r2))
    seen, shared = np.zeros(len(r1), np.int64), np.zeros(len(r1), np.int64)
    for before in (n2 - barcode_length, np.zeros(len(r1), np.int64)):  # bases of the flipped mate before the probe
        use = np.flatnonzero((before >= 0) & (n2 >= PROBE) & (n1 >= PROBE))
        place = probe_places([r1[i] for i in use], [flipped[i][before[i] : before[i] + PROBE] for i in use])
        left = np.where(place < 0, 0, n1[use] - place)
        better = use[(left > 0) & (left >= seen[use])]
        seen[use] = np.maximum(seen[use], left)
        shared[better] = seen[better] + before[better]
    return shared


def trim_overlaps(pairs: DataFrame, barcode_length: int = 44) -> DataFrame:
    """r1, r2 and their qualities without what the mates share and without the barcode at the start of r1, and ``overlap``.

    Mates that overlap were read from a fragment of len(r1) + len(r2) - overlap bases: neither goes beyond it, r2 ends
    before the barcode and loses its first base, which stands for the tail.  A pair whose fragment ends inside the
    barcode is left out.  A null mate counts as empty.
    """

    @F.pandas_udf("int")
    def overlap(r1: pd.Series, r2: pd.Series) -> pd.Series:
        step = max(1, CELLS // max(1, int(r1.str.len().max()) + PROBE)) if len(r1) else 1
        parts = [mate_overlap(r1.iloc[i : i + step].tolist(), r2.iloc[i : i + step].tolist(), barcode_length) for i in range(0, len(r1), step)]
        return pd.Series(np.concatenate(parts or [np.zeros(0)]).astype(np.int32))

    # Else the filter below would move ahead of the columns that the mates are made of: the function would run twice, and
    # whole rows of the source would be queued beside it, on disk when they are long.
    overlap = overlap.asNondeterministic()
    mates = ["r1", "r2", "q1", "q2"]
    rows = pairs.select("cell_id", *[F.coalesce(c, F.lit("")).alias(c) for c in mates], "umi").withColumn("overlap", overlap("r1", "r2"))
    n1, n2, joined = F.length("r1"), F.length("r2"), F.col("overlap") > 0
    fragment = n1 + n2 - F.col("overlap")
    end1 = F.when(joined, F.least(n1, fragment)).otherwise(n1)
    end2 = F.when(joined, F.greatest(F.lit(0), F.least(n2, fragment - barcode_length))).otherwise(n2)
    from2 = F.when(joined, F.least(F.lit(1), end2)).otherwise(0)
    part = lambda c, start, end: F.substr(F.col(c), start + 1, F.greatest(end - start, F.lit(0))).alias(c)
    kept = rows.where(~(joined & (fragment < n1) & (fragment < barcode_length)))
    head = F.lit(barcode_length)
    return kept.select("cell_id", part("r1", head, end1), part("r2", from2, end2), part("q1", head, end1), part("q2", from2, end2), "umi", "overlap")


LINKERS = ("AGGA", "ACTC", "AAGG")


def find_linkers(reads: DataFrame, window: int = 300, barcode: int = 8, least: int = 10) -> DataFrame:
    """Adds ``place``, where barcode, linker, barcode, linker ... best fits in the first ``window`` bases of ``seq``, and ``linker_score``.

    Null where fewer than ``least`` of the 12 linker bases agree; the first of equal places counts.
    """
    frame = 4 * barcode + 4 * len(LINKERS)

    @F.pandas_udf("place int, linker_score int")
    def best(seq: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(seq), 2), np.int64)
        step = CELLS // (window + frame)
        for a in range(0, len(seq), step):
            texts = seq.iloc[a : a + step].tolist()
            size = np.array([min(len(t), window) for t in texts])
            letters = _letters(texts, window + frame)
            score = np.zeros((len(texts), window), np.int16)
            for j, linker in enumerate(LINKERS):
                for b, base in enumerate(linker):
                    at = barcode + (barcode + 4) * j + b
                    score += letters[:, at : at + window] == ord(base)
            score[np.arange(window) > size[:, None] - frame] = -1
            place = np.argmax(score, 1)
            out[a : a + step] = np.stack([place, score[np.arange(len(texts)), place]], 1)
        frames = pd.DataFrame(out, columns=["place", "linker_score"]).astype("Int32")
        return frames.mask(frames["linker_score"] < least)

    found = reads.withColumn("_b", best(F.coalesce("seq", F.lit(""))))
    return found.withColumn("place", F.col("_b.place")).withColumn("linker_score", F.col("_b.linker_score")).drop("_b")
