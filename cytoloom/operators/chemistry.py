"""Chemistries: barcodes of several pools at places that may shift, under one tolerance for all of them, and UMIs.

A pool's barcode is looked for at its anchor and then at its other places.  The whitelist is spread to all spellings within
one mismatch, so each place is one lookup in a small broadcast table and reads are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators.barcodes import neighbours
from cytoloom.operators.filters import small
from cytoloom.operators.layout import union_inputs

MATES = ("r1", "r2")


@dataclass(frozen=True)
class Pool:
    """Barcodes of ``pool`` in the whitelist, at 0-based ``places`` of the read; the first one is the anchor."""

    pool: int
    places: tuple[int, ...]
    width: int = 8


@dataclass(frozen=True)
class Chemistry:
    """Where the barcodes and the UMI of a kit stand.

    ``mate`` holds the barcodes, ``umi`` is a range of it or None.  A pool may be off by ``part`` mismatches (0 or 1) and
    all of them together by ``total``.  Of an accepted pair that mate loses what stands up to the end of its last barcode
    if ``trim`` says so, or up to that place if it is a number, and then its leading Ts if ``poly_t`` is set.
    """

    name: str
    pools: tuple[Pool, ...]
    mate: str = "r2"
    umi: tuple[int, int] | None = None
    total: int = 1
    part: int = 1
    trim: bool | int = True
    poly_t: bool = False


def spellings(whitelist: DataFrame, part: int) -> DataFrame:
    """(pool, tag, hit): each spelling within ``part`` mismatches with its nearest barcode, of equally near ones that of the smallest idx."""
    near = whitelist.select("pool", "idx", "name", "seq", F.explode(neighbours(F.col("seq"), part)).alias("tag"))
    best = near.groupBy("pool", "tag").agg(F.min(F.struct(S.hamming("seq", "tag").alias("distance"), "idx", "name")).alias("hit"))
    return best.where(F.col("hit.distance") <= part)


def assign_cells(pairs: DataFrame, whitelist: DataFrame, chemistry: Chemistry, library: str = "") -> DataFrame:
    """Every pair with cell_id, distance, umi and accepted, and its mates trimmed if it is.

    The nearest barcode of each pool counts, of equally near ones that at the earlier place of the pool's list.  A pair
    with a pool that has none, or whose distances add up to more than the total, keeps its mates; its cell_id, umi and
    distance are null.  Other columns stay.
    """
    columns = [c for c in pairs.columns if c not in ("cell_id", "umi", "distance", "accepted")]
    near, read = small(spellings(whitelist, chemistry.part)), F.col(chemistry.mate)
    out = pairs.select(*columns)
    best = []
    for n, pool in enumerate(chemistry.pools):
        hits = []
        for i, place in enumerate(pool.places):
            tag, hit = f"_tag{n}_{i}", f"_hit{n}_{i}"
            one = near.where(F.col("pool") == pool.pool).select(F.col("tag").alias(tag), F.struct("hit.distance", F.lit(i).alias("place"), "hit.idx", "hit.name").alias(hit))
            out = out.withColumn(tag, F.substr(read, F.lit(place + 1), F.lit(pool.width))).join(one, tag, "left").drop(tag)
            hits.append(hit)
        out = out.withColumn(f"_best{n}", F.least(*hits) if len(hits) > 1 else F.col(hits[0])).drop(*hits)
        best.append(f"_best{n}")
    distance = reduce(lambda a, b: a + b, [F.col(f"{b}.distance") for b in best])
    out = out.withColumn("distance", distance).withColumn("accepted", F.coalesce(F.col("distance") <= chemistry.total, F.lit(False)))
    ok = F.col("accepted")
    ends = [reduce(lambda a, iw: F.when(F.col(f"{b}.place") == iw[0], iw[1] + pool.width).otherwise(a), enumerate(pool.places), F.lit(0)) for b, pool in zip(best, chemistry.pools)]
    cut = F.greatest(*ends, F.lit(0)) if chemistry.trim is True else F.lit(int(chemistry.trim))
    rest = F.substr(read, cut + 1)
    if chemistry.poly_t:
        cut = cut + F.length(rest) - F.length(S.trim_poly_t(rest))
    quality = chemistry.mate.replace("r", "q")
    umi = F.lit("") if chemistry.umi is None else F.substr(read, F.lit(chemistry.umi[0] + 1), F.lit(chemistry.umi[1] - chemistry.umi[0]))
    made = {"cell_id": F.when(ok, S.cell_name([f"{b}.name" for b in best], library)), "umi": F.when(ok, umi), "distance": F.when(ok, F.col("distance")), chemistry.mate: F.when(ok, F.substr(read, cut + 1)).otherwise(read), quality: F.when(ok, F.substr(F.col(quality), cut + 1)).otherwise(F.col(quality))}
    return out.withColumns(made).select(*columns, "cell_id", "umi", "distance", "accepted")


#: Barcodes whose letters are looked up as numbers in tasks; longer lists are joined.
LISTED = 100_000


def place_histogram(reads: DataFrame, whitelist: DataFrame, mate: str = "r2", width: int = 8) -> DataFrame:
    """(pool, place, hits): how often barcodes of each pool stand, exactly, at each place of the reads.

    Windows are looked up before they are counted, so that only counts by pool and place are shuffled.  Barcodes of at most
    8 letters are numbers of 64 bits; where they are longer, not in ASCII or too many to be listed, windows are joined.
    """
    known = small(whitelist.select("pool", F.col("seq").alias("tag")).distinct())
    tags = sorted(r["tag"] for r in known.where(F.length("tag") == width).select("tag").distinct().limit(LISTED + 1).collect())
    if width > 8 or len(tags) > LISTED or not all(t.isascii() and "?" not in t for t in tags):
        windows = reads.select(F.posexplode(S.kmers(mate, width)).alias("place", "tag"))
        return windows.join(known, "tag").groupBy("pool", "place").agg(F.count("*").alias("hits"))
    listed = np.array([int.from_bytes(t.encode(), "big") for t in tags], np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One byte a letter; other letters than those of ASCII, which no barcode has, become question marks.
            texts = [t.encode("ascii", "replace") for t in batch.column(0).drop_null().to_pylist() if len(t) >= width]
            if not texts or not tags:
                continue
            size = np.array([len(t) for t in texts], np.int64)
            raw = np.frombuffer(b"".join(texts), np.uint8)
            number = np.zeros(len(raw) - width + 1, np.uint64)
            for i in range(width):
                number = number << np.uint64(8) | raw[i : len(raw) - width + 1 + i]
            begins = np.cumsum(size) - size
            at = np.flatnonzero(listed[np.minimum(np.searchsorted(listed, number), len(listed) - 1)] == number)
            read = np.searchsorted(begins, at, "right") - 1
            at, read = (x[at - begins[read] + width <= size[read]] for x in (at, read))
            found, n = np.unique((at - begins[read]) * len(tags) + np.searchsorted(listed, number[at]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // len(tags), pa.int32()), pa.array(tags, pa.string()).take(pa.array(found % len(tags))), pa.array(n)], names=["place", "tag", "n"])

    windows = reads.select(mate).mapInArrow(count, "place int, tag string, n long")
    return windows.join(known, "tag").groupBy("pool", "place").agg(F.sum("n").alias("hits"))


def find_places(histogram: DataFrame, share: float = 0.05) -> DataFrame:
    """(pool, place, rank): the places with at least ``share`` of a pool's hits, the most frequent first; of equal ones the first."""
    total = F.sum("hits").over(W.partitionBy("pool"))
    ranked = F.row_number().over(W.partitionBy("pool").orderBy(F.desc("hits"), "place")) - 1
    return histogram.withColumn("_total", total).withColumn("rank", ranked).where(F.col("hits") >= share * F.col("_total")).select("pool", "place", "rank")


def with_found_places(chemistry: Chemistry, places: DataFrame) -> Chemistry:
    """The chemistry with the places that were found for its pools; the table has a row for each place of a read at most."""
    found: dict[int, list[int]] = {}
    for r in places.sort("pool", "rank").collect():
        found.setdefault(r["pool"], []).append(r["place"])
    return replace(chemistry, pools=tuple(replace(p, places=tuple(found.get(p.pool, p.places))) for p in chemistry.pools))


def kits_of(rows: list[dict], pools: dict[str, int], shifts: tuple[int, ...] = (0, 1, -1)) -> list[Chemistry]:
    """Chemistries from a table of kits: names of three barcode sets and their places, length of the UMI and what is cut off.

    ``pools`` gives the pool of each barcode set in the whitelist; the barcodes may be shifted by ``shifts``.  The UMI
    stands at the start of the read.
    """
    made = []
    for row in rows:
        parts = [Pool(pools[row[f"bc{i}"]], tuple(int(row[f"bc{i}pos"]) + s for s in shifts)) for i in (1, 2, 3)]
        umi = int(row["umilen"] or 0)
        made.append(Chemistry(row["kit"], tuple(parts), "r2", (0, umi) if umi else None, 1, 1, int(row["trim2"]), True))
    return made


def vote(pairs: DataFrame, whitelist: DataFrame, kits: list[Chemistry], first: int | None = None, order: str = "ordinal") -> DataFrame:
    """(kit, share): the kit that accepts the largest share of the pairs, or of the ``first`` ones; ties go to the smaller name."""
    rows = pairs.orderBy(order).limit(first) if first else pairs
    each = [assign_cells(rows, whitelist, kit).select(F.lit(kit.name).alias("kit"), "accepted") for kit in kits]
    shares = union_inputs(each).groupBy("kit").agg(F.avg(F.col("accepted").cast("int")).alias("share"))
    return shares.orderBy(F.desc("share"), "kit").limit(1)


#: Letters of a batch that are compared at once.
CELLS = 1 << 20


def edit_places(reads: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """For each read the least edit distance of the pattern to any part of it, and where the first such part ends.

    The columns of the distance table are kept as bits that tell whether it rises or falls down the pattern, one 64-bit
    number a read, and all reads advance by a letter together.  N agrees with nothing; a pattern has 1 to 64 letters.
    """
    m = len(pattern)
    if not 0 < m <= 64:
        raise ValueError("a pattern has 1 to 64 letters")
    one, ones = np.uint64(1), np.uint64((1 << m) - 1)
    masks = np.zeros(256, np.uint64)
    for i, c in enumerate(pattern):
        if c != "N":
            masks[ord(c)] |= np.uint64(1 << i)
    size = np.array([len(r) for r in reads], np.int64)
    width = int(size.max(initial=0))
    letters = np.frombuffer(b"".join(r.encode("latin-1", "replace").ljust(width, b"\0") for r in reads), np.uint8).reshape(len(reads), width)
    up, down = np.full(len(reads), ones), np.zeros(len(reads), np.uint64)
    score, last = np.full(len(reads), m, np.int64), np.uint64(m - 1)
    best, end = score.copy(), np.zeros(len(reads), np.int64)
    for j in range(width):
        equal = masks[letters[:, j]]
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        rise, fall = down | ~(diagonal | up), up & diagonal
        score += ((rise >> last) & one).astype(np.int64) - ((fall >> last) & one).astype(np.int64)
        rise, fall = rise << one, fall << one
        up, down = (fall | ~(vertical | rise)) & ones, rise & vertical & ones
        better = (score < best) & (j < size)
        best[better], end[better] = score[better], j + 1
    return best, end


def find_barcodes(reads: DataFrame, whitelist: DataFrame, column: str = "seq", most: int = 1) -> DataFrame:
    """Adds name, idx, distance and end of the barcode that stands in ``column`` with the fewest edits, at most ``most``.

    Of equally near ones the smallest idx counts, and the first place where it ends; null where none is near enough and for
    null reads.  The whitelist comes to the driver as it is: a few hundred barcodes of at most 64 letters.
    """
    listed = [tuple(r) for r in whitelist.select("idx", "name", "seq").sort("idx").collect()]

    @F.pandas_udf("name string, idx int, distance int, end int")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for seq in batches:
            distance, end, which = np.full(len(seq), most + 1), np.zeros(len(seq), np.int64), np.full(len(seq), -1)
            step = max(1, CELLS // max(1, int(seq.str.len().max()))) if len(seq) else 1
            for a in range(0, len(seq), step):
                part = slice(a, a + step)
                texts = seq.iloc[part].tolist()
                for n, (_, _, pattern) in enumerate(listed):
                    d, e = edit_places(texts, pattern)
                    better = d < distance[part]
                    distance[part] = np.where(better, d, distance[part])
                    end[part], which[part] = np.where(better, e, end[part]), np.where(better, n, which[part])
            names, idx = np.array([x[1] for x in listed] + [None], object), np.array([x[0] for x in listed] + [0])
            number = lambda values: pd.array(np.where(which < 0, None, values), "Int32")  # noqa: B023, E731
            yield pd.DataFrame({"name": names[which], "idx": number(idx[which]), "distance": number(distance), "end": number(end)})

    hit = reads.withColumn("_hit", search(F.coalesce(column, F.lit(""))))
    given = F.col(column).isNotNull()
    return hit.withColumns({c: F.when(given, F.col(f"_hit.{c}")) for c in ("name", "idx", "distance", "end")}).drop("_hit")
