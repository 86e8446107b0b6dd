"""Exact repeated substrings: every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else.

Candidates.  Of the SEED-byte strings that start in a window of WINDOW places, the one with the least hash is an
anchor; a LENGTH-byte string holds a whole window, and equal strings have their anchor at the same place.  So a repeat
shows as two equal anchors, and only a fiftieth of the places is shuffled.

Decision.  Occurrences of an anchor with equal surroundings that meet in one batch become spans there, and one of them
stands for all further on, so an anchor that a third of all rows hold is shuffled once a batch.  Occurrences of an anchor whose surroundings agree over all strings that hold it are settled by the hash of
these surroundings.  The rest, near edits and ends of texts, sends its surroundings.  They are cut into phrases where
eight bytes hash low, and a suffix array over the phrases, by linear grouping construction, tells how many phrases each
suffix shares with any other at the same distance from the same anchor.  A string can repeat only if its whole phrases
are shared; those that can are compared byte for byte by a hash of all their bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cytoloom.llm.shingles import mix
from cytoloom.llm.suffix_array import common_prefixes, suffix_array
from cytoloom.scratch import bound_batches, materialise

LENGTH, SEED = 200, 64
WINDOW = LENGTH - SEED + 1
REMEMBERED = 100_000
#: So many text keys are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_KEYS = 4_000_000
#: Surroundings of one anchor that one task compares; larger groups are compared by a shuffle of their strings.
GROUP = 20_000
#: Bytes that make a border of phrases, and how many of their hash's first bits must be 0: phrases of 32 bytes on average.
MARK, PHRASE_BITS = 8, 5
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASE = 0xD1342543DE82EF95
CHUNK = 1 << 16
POWERS = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, np.uint64(BASE))])
INVERSE = np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, np.uint64(pow(BASE, -1, 1 << 64)))])


class Rolling:
    """Hashes of all substrings of a text from prefix sums modulo 2**64."""

    def __init__(self, raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        n = len(buf) + 1
        if n > len(POWERS):
            self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(b))]) for b in (BASE, pow(BASE, -1, 1 << 64)))
        else:
            self.power, self.inverse = POWERS, INVERSE
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(TABLE[buf] * self.power[: n - 1], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all(self, length: int) -> np.ndarray:
        m = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:m]) * self.inverse[:m])


def anchors(raw: bytes) -> tuple[np.ndarray, ...]:
    """Of each anchor: hash, hash of its surroundings, whether a text end cuts them, place, first and last string start it stands for."""
    roll = Rolling(raw)
    h = roll.all(SEED)
    m = len(h) - WINDOW + 1
    blocks = np.r_[h, np.full(-len(h) % WINDOW, np.uint64(2**64 - 1))].reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks, 1).ravel()[WINDOW - 1 : WINDOW - 1 + m]
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()[:m]
    least = np.minimum(ahead, behind)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    hits = np.flatnonzero(np.isin(h, least[starts]))
    by_hash = hits[np.argsort(h[hits])]
    if len(np.unique(h[hits])) == len(hits):
        place = by_hash[np.searchsorted(h[by_hash], least[starts])]
        first, last = starts, np.r_[starts[1:], m] - 1
    else:
        place, first, last = _tied(h, least)
    low, high = place + SEED - LENGTH, place + LENGTH
    cut = (low < 0) | (high > len(raw))
    around = roll.at(np.maximum(low, 0), np.minimum(high, len(raw)))
    return h[place], around, cut, place, first, last


def _tied(h: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where a text repeats an anchor: each start takes the first equal hash in its window."""
    order = np.lexsort((np.arange(len(h)), h))
    hs = h[order]
    want = np.searchsorted(hs, least, "left")
    end = np.searchsorted(hs, least, "right")
    starts = np.arange(len(least))
    # (hash, place) pairs in order: find the first place >= start among equal hashes
    group = np.searchsorted(np.unique(hs), hs)
    key = group.astype(np.int64) * (len(h) + 1) + order
    mine = group[np.minimum(want, len(hs) - 1)].astype(np.int64) * (len(h) + 1) + starts
    place = order[np.minimum(np.searchsorted(key, mine), end - 1)]
    turn = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[turn], turn, np.r_[turn[1:], len(least)] - 1


ANCHORS = "anchor long, around long, cut boolean, span boolean, key long, place int, first int, last int"


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, seen = [c.split()[0] for c in ANCHORS.split(", ")], OrderedDict()
    for b in batches:
        for some in np.array_split(np.arange(len(b)), max(1, len(b) // 500)):
            parts = []
            for key, text in zip(b["key"].iloc[some], b["text"].iloc[some]):
                if key in seen:
                    continue
                seen[key] = None
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
                h, around, cut, place, first, last = anchors(text.encode())
                around = np.where(cut, mix(around ^ mix(np.uint64(key & (2**64 - 1)) + place.astype(np.uint64))), around)
                parts.append((h.view(np.int64), around.view(np.int64), cut, cut & False, np.full(len(h), key), place, first, last))
            if parts:
                yield _once(pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*parts))})).astype({"place": "int32", "first": "int32", "last": "int32"})


def _once(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows with each anchor and surroundings once, and as rows marked ``span`` the runs of bytes of those that came more often.

    A span's bytes go from ``first`` to ``last``, and its text's key stands in for the anchor.
    """
    by = ["anchor", "around"]
    twice = rows[rows.duplicated(by, keep=False) & ~rows["cut"]].sort_values(["key", "place"], kind="stable")
    key, start = twice["key"].to_numpy(), twice["place"].to_numpy() + SEED - LENGTH
    # All spans are of one length, so a run ends where the next span of its text begins behind it.
    new = np.r_[True, (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 2 * LENGTH - SEED)] if len(key) else np.zeros(0, bool)
    stop = np.r_[np.flatnonzero(new)[1:], len(key)] - 1 if len(key) else np.zeros(0, int)
    spans = pd.DataFrame({"anchor": key[new], "around": 0, "cut": False, "span": True, "key": key[new], "place": 0, "first": start[new], "last": start[stop] + 2 * LENGTH - SEED})
    return pd.concat([rows[~rows.duplicated(by) | rows["cut"]], spans], ignore_index=True)


FOUND = "anchor long, key long, place int, start int, end int"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by anchor and surroundings: spans that repeat, and one row to compare for each distinct surroundings.

    A row needs to know only its neighbours and the first surroundings of its anchor, so memory does not grow with a group.
    """
    held: pd.DataFrame | None = None
    before: tuple | None = None  # anchor, around, and the first surroundings of that anchor

    def decide(rows: pd.DataFrame, after: tuple | None) -> pd.DataFrame:
        nonlocal before
        a, f = rows["anchor"].to_numpy(), rows["around"].to_numpy()
        same_a = np.r_[bool(before) and before[0] == a[0], a[1:] == a[:-1]]
        same_f = same_a & np.r_[bool(before) and before[1] == f[0], f[1:] == f[:-1]]
        next_a = np.r_[same_a[1:], bool(after) and after[0] == a[-1]]
        next_f = np.r_[same_f[1:], bool(after) and after[:2] == (a[-1], f[-1])]
        head = np.maximum.accumulate(np.where(same_a, -1, np.arange(len(a))))
        lead = np.where(head < 0, before[2] if before else 0, f[np.maximum(head, 0)])
        twice = same_f | next_f
        compare = ~next_f & (next_a | (lead != f))
        before = (a[-1], f[-1], lead[-1])
        spans = rows[twice & ~rows["cut"].to_numpy()]
        ask = rows[compare]
        return pd.concat([pd.DataFrame({"anchor": None, "key": spans["key"], "place": None, "start": spans["place"] + SEED - LENGTH, "end": spans["place"] + LENGTH}), pd.DataFrame({"anchor": ask["anchor"], "key": ask["key"], "place": ask["place"], "start": ask["first"], "end": ask["last"] + LENGTH})]).astype({"anchor": "Int64", "place": "Int32"})

    last_row: tuple | None = None
    for b in batches:
        if b["span"].any():
            done = b[b["span"]]
            yield pd.DataFrame({"anchor": None, "key": done["key"], "place": None, "start": done["first"], "end": done["last"]}).astype({"anchor": "Int64", "place": "Int32"})
            b = b[~b["span"]]
        if not len(b):
            continue
        ident = list(zip(b["anchor"].iloc[[0]], b["around"].iloc[[0]], b["key"].iloc[[0]], b["place"].iloc[[0]]))[0]
        repeat = b[["anchor", "around", "key", "place"]].duplicated().to_numpy()
        repeat[0] = ident == last_row
        last_row = tuple(b[["anchor", "around", "key", "place"]].iloc[-1])
        rows = b[~repeat] if held is None else pd.concat([held, b[~repeat]], ignore_index=True)
        if not len(rows):
            continue
        held = rows.tail(1)
        if len(rows) > 1:
            yield decide(rows.iloc[:-1], (held["anchor"].iloc[0], held["around"].iloc[0]))
    if held is not None:
        yield decide(held, None)


AROUND = "anchor long, key long, place int, start int, bytes binary"


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for key, z, asks in zip(b["key"], b["z"], b["asks"]):
            raw = zlib.decompress(z)
            yield pd.DataFrame([(x["anchor"], key, x["place"], x["start"], raw[x["start"] : x["end"]]) for x in asks], columns=[c.split()[0] for c in AROUND.split(", ")])


def _strings(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, distance from the anchor, place in the joined bytes and hash of every LENGTH-byte string of the rows."""
    ends = np.cumsum([len(x) for x in rows["bytes"]])
    h = Rolling(b"".join(rows["bytes"])).all(LENGTH)
    sizes = np.diff(np.r_[0, ends]) - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), sizes)
    within = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    at = np.r_[0, ends[:-1]][row] + within
    distance = (rows["start"].to_numpy() - rows["place"].to_numpy())[row] + within
    return row, distance, at, h[at]


def _spans(rows: pd.DataFrame, row: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Runs of neighbouring string starts of one row, as spans of bytes."""
    if not len(row):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "start": np.zeros(0, np.int32), "end": np.zeros(0, np.int32)})
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]
    stop = np.r_[np.flatnonzero(new)[1:], len(row)] - 1
    return pd.DataFrame({"key": rows["key"].to_numpy()[row[new]], "start": start[new].astype(np.int32), "end": (start[stop] + LENGTH).astype(np.int32)})


def _shared_phrases(rows: pd.DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the joined bytes where phrases begin or end, and how many phrases from there on stand in another row.

    A border depends on the MARK bytes before it alone, so equal strings have equal borders.  A phrase counts with its
    group and its distance from the anchor: a row shares only what stands at the same place beside the same anchor.
    """
    sizes = np.array([len(x) for x in rows["bytes"]])
    ends = np.cumsum(sizes)
    roll = Rolling(b"".join(rows["bytes"]))
    at = np.flatnonzero(roll.all(MARK) >> np.uint64(64 - PHRASE_BITS) == 0)
    row = np.searchsorted(ends, at, "right")
    inside = at + MARK <= ends[row]
    border, row = at[inside] + MARK, row[inside]
    shared = np.zeros(len(border), np.int64)
    opens = np.flatnonzero(row[1:] == row[:-1])  # borders with another one behind them in their row
    if not len(opens):
        return border, shared
    owner = row[opens]
    distance = border[opens] - (ends - sizes)[owner] + (rows["start"].to_numpy() - rows["place"].to_numpy())[owner]
    phrase = mix(mix(group[owner].astype(np.uint64) * np.uint64(1024) + (distance + LENGTH).astype(np.uint64)) ^ roll.at(border[opens], border[opens + 1]))
    # One symbol a phrase, a 1 behind each row and a 0 at the very end.
    spot = np.arange(len(opens)) + owner
    text = np.ones(len(opens) + len(rows) + 1, np.int64)
    text[spot] = np.unique(phrase, return_inverse=True)[1] + 2
    text[-1] = 0
    symbols = text.tolist()
    order = suffix_array(symbols)
    common = np.array([*common_prefixes(symbols, order), 0])
    most = np.empty(len(text), np.int64)
    most[order] = np.maximum(common[:-1], common[1:])
    stop = np.searchsorted(owner, owner, "right")  # a run ends with its row
    shared[opens] = np.minimum(most[spot], stop - np.arange(len(opens)))
    return border, shared


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans whose strings stand twice in one anchor's surroundings; rows come sorted by anchor, groups of at most GROUP rows."""
    held: list[pd.DataFrame] = []

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        group = np.cumsum(np.r_[0, np.diff(rows["anchor"].to_numpy()) != 0])
        row, distance, at, h = _strings(rows)
        border, shared = _shared_phrases(rows, group)
        first, last = np.searchsorted(border, at + MARK), np.searchsorted(border, at + LENGTH, "right") - 1
        able = last <= first
        able[~able] = shared[first[~able]] >= (last - first)[~able]
        row, distance, h = row[able], distance[able], h[able]
        place = mix(mix(group[row].astype(np.uint64) * np.uint64(1024) + (distance + LENGTH).astype(np.uint64)) ^ h)
        order = np.argsort(place, kind="stable")
        same = place[order][1:] == place[order][:-1]
        twice = np.zeros(len(place), bool)
        if len(place):
            twice[order] = np.r_[False, same] | np.r_[same, False]
        return _spans(rows, row[twice], (rows["place"].to_numpy()[row] + distance)[twice])

    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) < 4_000:
            continue
        rows = pd.concat(held, ignore_index=True)
        edge = int(np.flatnonzero(np.r_[True, np.diff(rows["anchor"].to_numpy()) != 0])[-1])
        if edge:
            yield decide(rows.iloc[:edge])
        held = [rows.iloc[edge:]]
    if held:
        yield decide(pd.concat(held, ignore_index=True))


def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for some in np.array_split(np.arange(len(b)), max(1, len(b) // 500)):
            rows = b.iloc[some].reset_index(drop=True)
            if len(rows):
                row, distance, _, h = _strings(rows)
                yield pd.DataFrame({"anchor": rows["anchor"].to_numpy()[row], "distance": distance.astype(np.int32), "h": h.view(np.int64), "key": rows["key"].to_numpy()[row], "start": (rows["place"].to_numpy()[row] + distance).astype(np.int32)})


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for key, z, spans in zip(b["key"], b["z"], b["spans"]):
            raw = zlib.decompress(z)
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, [s["start"] for s in spans], 1)
            np.add.at(edge, [s["end"] for s in spans], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((key, int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["key", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text, whole (its SHA-256) and ``key``, a hash of the text that no other text of LENGTH bytes or more has; and the rows of each such key.

    Where two texts share their first hash, which is rare below some billions of texts, they take another one.
    """
    first = F.xxhash64("text")
    rows = docs.select("doc_id", "text", F.sha2("text", 256).alias("whole"), first.alias("key"))
    long_ = lambda some: some.where(F.octet_length("text") >= LENGTH).groupBy("key")
    sums = materialise(long_(rows).agg(F.count("*").alias("rows"), (F.min("whole") != F.max("whole")).alias("clash")), "keys")
    clashes = sums.where("clash").drop("rows")
    if clashes.isEmpty():
        return rows, sums.drop("clash")
    rows = rows.join(clashes, "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64(F.lit(1), "whole")).otherwise(F.col("key"))).drop("clash")
    return rows, materialise(long_(rows).agg(F.count("*").alias("rows")), "keys")


def _spans_table(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that hold repeats, and the spans by key."""
    keyed = rows.select("key", "text").where(F.octet_length("text") >= LENGTH)
    found = keyed.mapInPandas(_find, ANCHORS).repartition("anchor").sortWithinPartitions("anchor", "around", "key", "place")
    settled = materialise(found.mapInPandas(_settle, FOUND), "settled")
    asks = settled.where("anchor is not null")
    wanted = materialise(settled.select("key").distinct(), "wanted")
    n = wanted.count()

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: zlib.compress(t.encode(), 1))

    picked = F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted
    texts = materialise(keyed.join(picked, "key", "left_semi").select("key", packed("text").alias("z")).dropDuplicates(["key"]), "texts")
    by_key = asks.groupBy("key").agg(F.collect_list(F.struct("anchor", "place", "start", "end")).alias("asks"))
    around = by_key.join(texts, "key").select("key", "z", "asks").mapInPandas(_surroundings, AROUND)
    crowded = materialise(asks.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n > {GROUP}").select("anchor"), "crowded")
    spans = settled.where("anchor is null").select("key", "start", "end")
    if crowded.isEmpty():
        small = around
    else:
        around = materialise(around, "around")
        small = around.join(crowded, "anchor", "left_anti")
        strings = around.join(crowded, "anchor", "left_semi").mapInPandas(_exploded, "anchor long, distance int, h long, key long, start int")
        strings = materialise(strings, "strings")
        twice = strings.groupBy("anchor", "distance", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        spans = spans.unionByName(strings.join(twice, ["anchor", "distance", "h"]).select("key", "start", (F.col("start") + LENGTH).alias("end")))
    small = small.repartition("anchor").sortWithinPartitions("anchor")
    spans = spans.unionByName(small.mapInPandas(_compare, "key long, start int, end int"))
    return texts, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes) for each row.

    Texts count as UTF-8 bytes, null as empty.  Texts under LENGTH bytes keep all.  A text that two rows hold repeats
    as a whole; it is compared with other texts once.  Rows are judged by their text alone, so repeated or null ids do not matter.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs, many = _keyed(docs)
    texts, spans = _spans_table(docs)
    lone = many.where("rows = 1").select("key")
    marked = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans")).join(lone, "key", "left_semi")
    cut = texts.join(marked, "key").select("key", "z", "spans").mapInPandas(_cut_out, "key long, n_removed long, n_spans long, kept_sha256 string")
    return _report(docs, many, cut)


def _report(docs: DataFrame, many: DataFrame, cut: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), "whole")
    copies = many.where("rows > 1").select("key", F.lit(True).alias("copied"))
    met = rows.join(copies, "key", "left").join(cut, "key", "left")
    copied = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    part = F.col("n_removed").isNotNull() & (F.col("n_bytes") >= LENGTH)
    pick = lambda all_, some, none: F.when(copied, all_).when(part, some).otherwise(none)
    return met.select("doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"), pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"), pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("whole")).alias("kept_sha256"))
