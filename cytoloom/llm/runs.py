"""Periodic runs of words by the runs theorem.

Every run has a Lyndon root that is the longest Lyndon word at its start under the order of the words or under the
opposite one.  In the inverse suffix array these words end at the next smaller and at the next greater value.  Each of
them is extended to both sides as far as its period holds: two suffixes agree for as long as the least common prefix
between their places in the suffix array, which a sparse table answers; to the left this is asked of the reversed text.
Texts of a batch are laid one after the other, each ended by a symbol of its own, so that arrays stay long when texts are
short.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cytoloom.llm.texts import map_texts

#: Shortest run in words, and about how many words are worked on at once (a longer text is worked on whole).
LEAST, CHUNK = 12, 1 << 18
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, inverse and common prefixes (of each place with the one before) by prefix doubling.

    Only groups that are still of two or more are sorted again; every text ends with a symbol that stands nowhere else.
    """
    n = len(x)
    array = np.argsort(x, kind="stable")
    head = np.ones(n, bool)
    head[1:] = np.diff(x[array]) != 0
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        at = array[open_]
        key = rank[at] * n + rank[at + width]
        order = np.argsort(key, kind="stable")
        array[open_], key = at[order], key[order]
        head[open_[1:]] |= np.diff(key) != 0
        rank[array[open_]] = np.maximum.accumulate(np.where(head[open_], open_, 0))
        levels.append(rank.astype(np.int32))
        width *= 2
    common = np.zeros(n, np.int64)
    left, right = array[:-1].copy(), array[1:].copy()
    for k in reversed(range(len(levels))):
        same = levels[k][left] == levels[k][right]
        step = same.astype(np.int64) << k
        left += step
        right += step
        common[1:] += step
    return array, rank, common


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range [low, high); the sparse table is made level by level and each level answers its ranges."""
    out = np.zeros(len(low), np.int64)
    level = np.frexp((high - low).astype(float))[1] - 1
    by_level = np.argsort(level, kind="stable")
    borders = np.searchsorted(level[by_level], np.arange(level.max(initial=0) + 2))
    table = values
    for k in range(level.max(initial=0) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        asked = by_level[borders[k] : borders[k + 1]]
        out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k)])
    return out


def _agreed(rank: np.ndarray, common: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at i and j share."""
    a, b = rank[i], rank[j]
    return _range_minimum(common, np.minimum(a, b) + 1, np.maximum(a, b) + 1)


def _next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, or the length."""
    out, waiting = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def _repetitive(texts: list[np.ndarray], words: int) -> np.ndarray:
    """Which texts may say ``words`` words twice (a hash of them does): no other text has a run of twice that length."""
    lengths = np.array([len(t) for t in texts])
    whole = np.concatenate(texts).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), lengths)
    h = np.zeros(max(0, len(whole) - words + 1), np.uint64)
    for k in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + whole[k : k + len(h)]
    inside = of[: len(h)] == of[words - 1 :]
    keys = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))[inside] ^ of[: len(h)][inside].astype(np.uint64)
    owner = of[: len(h)][inside]
    order = np.argsort(keys)
    twice = np.flatnonzero(np.diff(keys[order]) == 0)
    found = np.zeros(len(texts), bool)
    found[owner[order[twice]]] = True
    return found


def find_runs(texts: Sequence[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each text of symbols (integers from 0 on) its runs of at least ``least`` symbols: start, length, period, sorted."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    kept = [k for k, t in enumerate(texts) if len(t) >= max(2, least)]
    if kept and (least + 1) // 2 > 1:
        may = _repetitive([texts[k] for k in kept], (least + 1) // 2)
        kept = [k for k, m in zip(kept, may) if m]
    if not kept:
        return out
    lengths = np.array([len(texts[k]) for k in kept])
    ends = np.cumsum(lengths + 1) - 1  # where the ending symbols stand
    begins = ends - lengths
    of = np.repeat(np.arange(len(kept)), lengths + 1)
    base = max(int(texts[k].max()) for k in kept) + 2
    forward, backward = (np.zeros(len(of), np.int64) for _ in range(2))
    for k, a, e in zip(kept, begins, ends):
        forward[a:e], backward[a:e] = texts[k] + 1, texts[k][::-1] + 1
    forward, backward = forward + of * base, backward + of * base
    _, rank, common = _suffix_order(forward)
    _, rank_back, common_back = _suffix_order(backward)
    at = np.arange(len(of))
    smaller, greater = np.array(_next_smaller(rank.tolist())), np.array(_next_smaller((-rank).tolist()))
    # A text's ending symbol is its smallest; a greater value behind it belongs to another text and ends no word.
    i = np.concatenate([at, at])
    j = np.concatenate([smaller, greater])
    good = (i < ends[of[i]]) & (j <= ends[of[i]])
    i, j = i[good], j[good]
    mirror = begins[of[i]] + ends[of[i]]
    ahead = _agreed(rank, common, i, j)
    behind = _agreed(rank_back, common_back, mirror - i, mirror - j)
    length, period = ahead + behind + j - i, j - i
    good = length >= np.maximum(least, 2 * period)
    found = np.unique(np.stack([of[i], i - behind, length, period], 1)[good], axis=0)
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    borders = np.searchsorted(found[:, 0], np.arange(len(kept) + 1))
    for n, k in enumerate(kept):
        part = found[borders[n] : borders[n + 1], 1:]
        out[k] = part - [begins[n], 0, 0]
    return out


def collapse(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def periodic(words: list[bytes], h: int) -> list[bytes]:
    """The words with a period planted behind a prefix, for a tenth of the hashes."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def _report(words: list[bytes], runs: np.ndarray) -> tuple:
    kept = words if not len(runs) else [w for w, k in zip(words, collapse(len(words), runs)) if k]
    listed = "".join(f"{s},{k},{p}\n" for s, k, p in runs.tolist())
    first = (None,) * 4
    if len(runs):
        s, k, p = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        first = (s, k, p, 1000 * k // p)
    return len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]


def _reports(rows: list[dict]) -> list[tuple]:
    out, held, size = [], [], 0
    for place, row in enumerate(rows):
        words = (row["text"] or "").encode().split()
        held.append(words if row["h"] is None else periodic(words, row["h"]))
        size += len(words)
        if size >= CHUNK or place == len(rows) - 1:
            out += [(len(out) + k, *_report(w, r)) for k, (w, r) in enumerate(zip(held, find_runs(_numbered(held))))]
            held, size = [], 0
    return out


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, digests of all runs and of the collapsed text, for every row of ``docs``.

    Words are what white space of ASCII parts.  A tenth of the ids get a period planted; a null id gets none.  Null, empty
    and blank texts have no words and no runs, so the four columns of the longest run are null; of equally long runs the
    first counts, then the one of the smaller period.  Long texts are searched whole.  Repeated rows give equal rows, an
    empty table an empty one, and other columns are ignored.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.struct(F.col("text").alias("text"), h.alias("h")).alias("text"))
    return map_texts(rows, lambda: _reports, SCHEMA)


def collapse_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id and text with each run cut down to its first period; a text without runs stays as it is, null too."""

    def collapsed(texts: list[str | None]) -> list[tuple]:
        words = [(t or "").encode().split() for t in texts]
        found = find_runs(_numbered(words), least)
        return [(k, t if not len(r) else b" ".join([w for w, kept in zip(ws, collapse(len(ws), r)) if kept]).decode()) for k, (t, ws, r) in enumerate(zip(texts, words, found))]

    return map_texts(docs, lambda: collapsed, "text string")
