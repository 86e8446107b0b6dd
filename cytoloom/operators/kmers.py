"""K-mer counting, lookup and sketches.

The windows of a batch of reads become numbers in numpy and are counted before they leave the task; windows with other
letters, and those longer than 31, are counted as strings beside them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytoloom.functions import sequence as S
from cytoloom.operators import hashes
from cytoloom.operators.filters import small

#: Letters of reads that are taken apart at once, and sketch entries that a task holds before it hands them on.
LETTERS, HELD = 1 << 20, 1 << 20
#: Windows that are put aside at least before they are merged into what a task holds.
ASIDE = 1 << 16
FLIP = bytes.maketrans(b"ACGT", b"TGCA")


def alphabet(k: int) -> str:
    """The letters that a window's number can stand for; sorted, so that numbers are in the order of the strings.

    A signed long holds 27 letters of five and 31 of four.
    """
    return "ACGNT" if k <= 27 else "ACGT" if k <= 31 else ""


def read_kmers(reads: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(cell_id, kmer) of all windows of r1 and r2, one row each."""
    found = reads.select("cell_id", F.explode(F.concat(S.kmers("r1", k), S.kmers("r2", k))).alias("kmer"))
    return found.withColumn("kmer", S.canonical("kmer")) if canonical else found


def _windows(cells: np.ndarray, mates: list[bytes], k: int, canonical: bool, with_n: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Cell and number of every window of the alphabet, and cell and letters of every other one."""
    letters = alphabet(k)
    codes, flipped = np.full(256, len(letters), np.int64), np.zeros(len(letters) + 1, np.int64)
    codes[list(letters.encode())] = range(len(letters))
    flipped[:-1] = codes[list(letters.encode().translate(FLIP))]
    sizes = np.array([len(m) + 1 for m in mates], np.int64)
    raw = b"\n".join(mates) + b"\n"
    text = np.frombuffer(raw, np.uint8)
    n = max(0, len(text) - k + 1)
    bad = lambda where: np.diff(np.r_[0, np.cumsum(where)][[np.arange(n), np.arange(k, n + k)]], axis=0)[0] > 0
    inside = ~bad(text == 10)
    if not with_n:
        inside &= ~bad(text == ord("N"))
    owner, base = np.repeat(np.arange(len(mates)), sizes), codes[text]
    strange = bad(base == len(letters)) if letters else np.ones(n, bool)
    at, rest = np.flatnonzero(inside & ~strange), np.flatnonzero(inside & strange)
    forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(at):
        for j in range(k):
            part = base[j : j + n]
            forward = forward * len(letters) + part
            if canonical:
                back += flipped[part] * len(letters) ** j
    odd = [raw[i : i + k] for i in rest]
    if canonical:
        odd = [min(w, w.translate(FLIP)[::-1]) for w in odd]
    return cells[owner[at]], (np.minimum(forward, back) if canonical else forward)[at], cells[owner[rest]], odd


def _parts(batch: pa.RecordBatch, k: int, canonical: bool, with_n: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Names of the cells, and what _windows tells of some rows at a time."""
    mates = [[(x or "").encode() for x in batch.column(c).to_pylist()] for c in ("r1", "r2")]
    ends = np.cumsum([len(a) + len(b) + 2 for a, b in zip(*mates)], dtype=np.int64)
    names = batch.column("cell_id").dictionary_encode()
    cells = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    names = pa.concat_arrays([names.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LETTERS, "right")))
        yield names, *_windows(np.tile(cells[start:stop], 2), mates[0][start:stop] + mates[1][start:stop], k, canonical, with_n)
        start = stop


def _counted(batch: pa.RecordBatch, k: int, canonical: bool = False, with_n: bool = True) -> Iterator[pa.Table]:
    """(cell_id, code, odd, cnt) of the windows of some rows at a time; the code is -1 where ``odd`` holds the letters."""
    for names, cell, code, odd_cell, odd in _parts(batch, k, canonical, with_n):
        found = _sums(pa.table({"cell": cell, "code": code}))
        found = found.append_column("odd", pa.repeat("", len(found)))
        if odd:
            found = pa.concat_tables([found, _sums(pa.table({"cell": odd_cell, "code": np.full(len(odd), -1), "odd": [w.decode() for w in odd]})).select(found.column_names)])
        yield pa.table({"cell_id": names.take(found["cell"].combine_chunks()), "code": found["code"], "odd": found["odd"], "cnt": found["cnt"]})


def _sums(rows: pa.Table) -> pa.Table:
    """Equal rows once, with their number as cnt."""
    found = rows.group_by(rows.column_names, use_threads=False).aggregate([([], "count_all")])
    return found.rename_columns([*rows.column_names, "cnt"])


def _letters(codes: np.ndarray, k: int) -> np.ndarray:
    """The letters of each code as a row of bytes."""
    letters = np.frombuffer(alphabet(k).encode(), np.uint8)
    text, rest = np.empty((len(codes), k), np.uint8), codes.copy()
    for j in range(k - 1, -1, -1):
        rest, digit = np.divmod(rest, len(letters) or 1)
        text[:, j] = letters[digit]
    return text


def _strings(text: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(text).reshape(-1).view(f"S{text.shape[1]}") if len(text) else [], pa.binary()).cast(pa.string())


def _spelled(table: pa.Table, k: int) -> pa.Table:
    """Counted windows with their letters as kmer; they share their letters, so each number is spelled once."""
    code = table["code"].to_numpy()
    each, which = np.unique(code, return_inverse=True)
    each = each[each >= 0]
    text = _letters(each, k)
    plain = _strings(text)
    plain = plain.take(pa.array(np.where(code < 0, 0, which - (len(code) and int(code.min() < 0))), mask=code < 0))
    return table.append_column("kmer", pc.coalesce(plain, table["odd"].combine_chunks()))


def spelled_counts(reads: DataFrame, k: int, canonical: bool = False) -> DataFrame:
    """(cell_id, kmer, cnt) as window_counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _counted(batch, k, canonical):
                yield from _spelled(table, k).select(["cell_id", "kmer", "cnt"]).to_batches(max_chunksize=100_000)

    return reads.select("cell_id", "r1", "r2").mapInArrow(rows, "cell_id string, kmer string, cnt long")


def window_counts(reads: DataFrame, k: int, canonical: bool = False, with_n: bool = True) -> DataFrame:
    """(cell_id, code, odd, cnt): windows of r1 and r2, counted batch by batch, so that a window may come in several rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table in _counted(batch, k, canonical, with_n):
                yield from table.to_batches(max_chunksize=100_000)

    return reads.select("cell_id", "r1", "r2").mapInArrow(rows, "cell_id string, code long, odd string, cnt long")


def letters_of(code: Column, odd: Column, k: int) -> Column:
    """The k-mer of a code, or ``odd`` where there is none."""
    letters = alphabet(k) or "AC"
    digits = F.lpad(F.conv(code.cast("string"), 10, len(letters)), k, "0")
    return F.when(code < 0, odd).otherwise(F.translate(digits, "01234"[: len(letters)], letters))


def code_of(kmer: Column, k: int) -> tuple[Column, Column]:
    """The code and odd columns that a k-mer has in window_counts."""
    letters = alphabet(k)
    if not letters:
        return F.lit(-1).cast("long"), kmer
    plain = kmer.rlike(f"^[{letters}]*$")
    number = F.conv(F.translate(kmer, letters, "01234"[: len(letters)]), len(letters), 10).cast("long")
    return F.when(plain, number).otherwise(F.lit(-1).cast("long")), F.when(plain, F.lit("")).otherwise(kmer)


def kmer_counts(reads: DataFrame, k: int = 31) -> DataFrame:
    """Canonical k-mers of each cell; windows with N are left out."""
    found = window_counts(reads, k, canonical=True, with_n=False).groupBy("cell_id", "code", "odd").agg(F.sum("cnt").alias("cnt"))
    return found.select("cell_id", letters_of(F.col("code"), F.col("odd"), k).alias("kmer"), "cnt")


def kmer_union(counts: DataFrame) -> DataFrame:
    """The sum of all cells' k-mer tables."""
    return counts.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def feature_counts(reads: DataFrame, features: DataFrame, k: int) -> DataFrame:
    """How often each listed k-mer stands in a cell's reads, on either strand; a palindrome counts twice a window.

    The list is turned, not the reads: each listed k-mer is looked up as it is and as its reverse complement.
    """
    listed = features.select("kmer").where(F.length("kmer") == k).distinct()
    probes = listed.select(F.col("kmer").alias("feature"), F.explode(F.array("kmer", S.revcomp("kmer"))).alias("probe"))
    code, odd = code_of(F.col("probe"), k)
    met = window_counts(reads, k).join(small(probes.select("feature", code.alias("code"), odd.alias("odd"))), ["code", "odd"])
    return met.groupBy("cell_id", "feature").agg(F.sum("cnt").alias("cnt"))


def dump_lookup(dump: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of a k-mer table (cell_id, kmer, cnt) whose k-mer is listed."""
    return dump.join(small(features.select("kmer").distinct()), "kmer").select("cell_id", F.col("kmer").alias("feature"), "cnt")


def _hashes(words: list[bytes], by: str) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers without sign for each word: xxhash64 as Spark's function of that name and 0, or the halves of its md5."""
    if by == "xxhash64":
        return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64), np.zeros(len(words), np.uint64)
    halves = np.frombuffer(b"".join(hashlib.md5(w).digest() for w in words), ">u8").astype(np.uint64)
    return halves[::2], halves[1::2]


def _hashed(text: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray]:
    """As _hashes, of rows of bytes."""
    if by == "xxhash64" and text.shape[1] <= hashes.LONGEST_XXHASH:
        each = [hashes.xxhash64(text[i : i + hashes.ROWS]) for i in range(0, len(text), hashes.ROWS)]
        return np.concatenate(each or [np.zeros(0, np.uint64)]), np.zeros(len(text), np.uint64)
    if by == "md5" and text.shape[1] <= hashes.LONGEST_MD5:
        return hashes.md5(text)
    return _hashes([t.tobytes() for t in text], by)


def _order(x: np.ndarray, by: str) -> np.ndarray:
    """Longs in whose order sketches take the hashes: md5 without sign, xxhash64 with it, as Spark's column has it."""
    return (x if by == "xxhash64" else x ^ np.uint64(1 << 63)).view(np.int64)


def _first(cell: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which windows of each cell have one of its n smallest hashes, repeats counted; equal hashes stay together."""
    order = np.lexsort((high, cell))
    c, h = cell[order], high[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(c)])
    most = h[first + np.minimum(sizes, n) - 1]
    keep = np.zeros(len(c), bool)
    keep[order] = h <= np.repeat(most, sizes)
    return keep


def _least(rows: pa.Table, n: int) -> pa.Table:
    """Of each cell the windows that come first by hash, until ``n`` are together with their repeats."""
    rows = rows.group_by(["cell_id", "high", "low", "kmer"], use_threads=False).aggregate([("cnt", "sum")]).rename_columns(["cell_id", "high", "low", "kmer", "cnt"])
    cell = rows["cell_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = rows.select(["high", "low", "kmer"]).append_column("cell", pa.array(cell))
    rows = rows.take(pc.sort_indices(order, [(c, "ascending") for c in ("cell", "high", "low", "kmer")]))
    cell, cnt = np.sort(cell), np.minimum(rows["cnt"].to_numpy(), n)
    upto = np.cumsum(cnt)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
    before = upto - cnt - np.repeat((upto - cnt)[first], np.diff(np.r_[first, len(cell)]))
    return rows.set_column(4, "cnt", pa.array(cnt)).filter(pa.array(before < n))


NO_LIMIT = np.iinfo(np.int64).max


def _merged(held: pa.Table | None, aside: list[pa.Table], n: int) -> tuple[pa.Table, dict[str | None, int]]:
    """The sketches of all the tables, and for each cell that is full the hash that ends it."""
    best = _least(pa.concat_tables([*([held] if held is not None else []), *aside]), n)
    sums = best.group_by("cell_id", use_threads=False).aggregate([("cnt", "sum"), ("high", "max")])
    return best, {c: h for c, total, h in zip(*(sums[x].to_pylist() for x in ("cell_id", "cnt_sum", "high_max"))) if total >= n}


PARTS = "cell_id string, high long, low long, kmer string, cnt long"


def sketch_parts(reads: DataFrame, k: int, n: int, by: str = "xxhash64") -> DataFrame:
    """PARTS: of each cell and task the windows with the smallest hashes, which merge into the cell's sketch.

    A task holds about HELD rows.
    """

    def words(names: pa.Array, cell: np.ndarray, high: np.ndarray, low: np.ndarray, kmers: pa.Array) -> pa.Table:
        return pa.table({"cell_id": names.take(pa.array(cell)), "high": high, "low": low, "kmer": kmers, "cnt": np.ones(len(cell), np.int64)})

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, aside, waiting, limits = None, [], 0, {}
        for batch in batches:
            for names, cell, code, odd_cell, odd in _parts(batch, k, False, True):
                each, which = np.unique(code, return_inverse=True)
                high, low = (_order(x, by)[which] for x in _hashed(_letters(each, k), by))
                # A cell that is full takes only windows that come before its last one.
                limit = np.array([limits.get(c, NO_LIMIT) for c in names.to_pylist()], np.int64)
                near = np.flatnonzero(high <= limit[cell])
                near = near[_first(cell[near], high[near], n)]
                found = [words(names, cell[near], high[near], low[near], _strings(_letters(code[near], k)))] if len(near) else []
                if odd:
                    found.append(words(names, odd_cell, *(_order(x, by) for x in _hashes(odd, by)), pa.array([w.decode() for w in odd], pa.string())))
                for table in found:
                    aside.append(_least(table, n))
                    waiting += len(aside[-1])
                if aside and (held is None or waiting > max(ASIDE, len(held))):
                    held, limits = _merged(held, aside, n)
                    aside, waiting = [], 0
                if held is not None and len(held) > HELD:
                    yield from held.to_batches(max_chunksize=100_000)
                    held, limits = None, {}
        if aside:
            held, _ = _merged(held, aside, n)
        if held is not None:
            yield from held.to_batches(max_chunksize=100_000)

    return reads.select("cell_id", "r1", "r2").mapInArrow(sketch, PARTS)


def minhash(reads: DataFrame, k: int = 31, n: int = 1000, by: str = "xxhash64") -> DataFrame:
    """The n windows of each cell with the smallest hash (``xxhash64`` or ``md5``), repeats included, ties by the k-mer.

    Sketches of parts of a cell merge, so a task hands on its n best of each cell and no more is shuffled.
    """
    counted = sketch_parts(reads, k, n, by).groupBy("cell_id", "high", "low", "kmer").agg(F.sum("cnt").alias("cnt"))
    order = W.partitionBy("cell_id").orderBy("high", "low", "kmer")
    before = F.sum("cnt").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("cnt")
    return counted.withColumn("before", before).where(F.col("before") < n).select("cell_id", "kmer", F.least(F.col("cnt"), F.lit(n) - F.col("before")).alias("copies"))


def minhash_histogram(sketches: DataFrame) -> DataFrame:
    """In how many sketch entries each k-mer stands."""
    return sketches.groupBy("kmer").agg(F.sum("copies").alias("cnt"))


def count_sketch(reads: DataFrame, k: int = 31, size: int = 4096, by: str = "xxhash64") -> DataFrame:
    """(cell_id, pos, val) of a signed sketch over canonical k-mers; entries that are zero are left out.

    The sketch is linear: the sum of two tables' sketches is the sketch of both.  ``size`` is a power of two.  The hash is
    ``xxhash64``, or the number that the first 15 hex digits of the ``md5`` make.  Tasks hash each window of a batch once and
    hand on sums by cell and place.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, cell, code, odd_cell, odd in _parts(batch, k, True, True):
                each, which = np.unique(code, return_inverse=True)
                h = np.concatenate([_hashed(_letters(each, k), by)[0][which], _hashes(odd, by)[0]])
                h = h if by == "xxhash64" else h >> np.uint64(4)
                key = np.concatenate([cell, odd_cell]) * size + (h & np.uint64(size - 1)).astype(np.int64)
                key, which = np.unique(key, return_inverse=True)
                val = np.bincount(which, 1 - 2 * (h >> np.uint64(32) & np.uint64(1)).astype(np.int64), len(key)).astype(np.int64)
                yield from pa.table({"cell_id": names.take(pa.array(key // size)), "pos": key % size, "val": val}).to_batches(max_chunksize=100_000)

    sums = reads.select("cell_id", "r1", "r2").mapInArrow(rows, "cell_id string, pos long, val long")
    return sums.groupBy("cell_id", "pos").agg(F.sum("val").alias("val")).where("val <> 0")


def sketch_depth(reads: DataFrame, k: int = 31) -> DataFrame:
    """K-mers that entered each cell's sketch, and mates too short to have any."""
    n = lambda c: F.greatest(F.length(c) - (k - 1), F.lit(0))
    short = lambda c: (F.length(c) < k).cast("int")
    return reads.groupBy("cell_id").agg(F.sum(n("r1") + n("r2")).cast("long").alias("depth"), F.sum(short("r1") + short("r2")).cast("long").alias("skipped"))


def sketch_matrix(sketch: DataFrame, depth: DataFrame, size: int) -> DataFrame:
    """(cell_id, depth, sketch): each cell's sketch as an array of ``size`` numbers."""
    dense = sketch.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "val"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    none = F.array_repeat(F.lit(0).cast("long"), size)
    return depth.select("cell_id", "depth").join(dense, "cell_id", "left").select("cell_id", "depth", F.when(F.col("m").isNull(), none).otherwise(full).alias("sketch"))
