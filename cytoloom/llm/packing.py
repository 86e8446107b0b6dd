"""Best-fit packing of tokenised documents into sequences by bin completion.

Only the lengths matter for a packing, and there are at most ``capacity`` of them.  So Spark tokenises, counts the
pieces of each length and deals them out; the search works on those counts: it completes the bin around the largest
length left and repeats that filling as often as the counts allow.  Where that needs more bins than a lower bound, a
branch and bound over the undominated fillings of each largest length goes on.  Its plan is a table of ranges of ranks within a
length, whose size depends on ``capacity`` alone and not on the number of documents.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cytoloom.llm.texts import map_texts
from cytoloom.scratch import materialise

CAPACITY = 2048
SEPARATOR = 0
#: Steps of the branch and bound over whole plans; when they are used up, the best plan found so far stands.
STEPS = 300_000
PIECES = "piece int, start long, length long, ids_crc32 long, task int, slot long"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of a text by the byte-level BPE in a tokenizers file, as little-endian bytes.

    The merges run in tiktoken over the same vocabulary, which gives the same ids in a fifth of the time; a text that spells
    a special token goes to the file's own tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).with_suffix(".tiktoken").read_bytes().splitlines())}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values() if t.special]

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4").tobytes()


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, capacity: int, keep_ids: bool):
    """Of each text the pieces of its ids: columns of PIECES, in which slot counts the pieces of one length in this task."""

    def make():
        encode, task, seen = _encoder(path), TaskContext.get().partitionId(), Counter()

        def cut(texts: list[str | None]) -> list[tuple]:
            rows = []
            for place, text in enumerate(texts):
                ids = encode(text or "") + SEPARATOR.to_bytes(4, "little")
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((place, piece, a, b - a, zlib.crc32(part), task, seen[b - a], *([part] if keep_ids else ())))
                    seen[b - a] += 1
            return rows

        return cut

    return make


def _copies(n: int) -> Iterator[int]:
    """Powers of two and a rest that add up to ``n``: any number up to it is a sum of some of them."""
    k = 1
    while n:
        yield min(k, n)
        n, k = n - min(k, n), 2 * k


def _best_fit(counts: dict[int, int], lengths: list[int], room: int) -> Counter:
    """The largest length that fits, again and again."""
    best = Counter()
    for x in lengths:
        if k := min(room // x, counts[x]):
            best[x], room = k, room - k * x
    return best


def complete_bin(counts: dict[int, int], lengths: list[int], room: int) -> Counter:
    """The filling of ``room`` that wastes least; of equals the one with the largest lengths first.

    ``lengths`` descends.  Best fit, the largest that fits again and again, is the incumbent and stands if it wastes
    nothing.  Otherwise fillings are enumerated largest first.  Which sums the lengths still to come can reach is known
    exactly, as the bits of one number for each, so a branch that cannot beat the incumbent is never entered, and the
    first filling that is reached is the best one: no larger pieces of the same sum could take the place of some of its own.
    """
    best = _best_fit(counts, lengths, room)
    left = room - sum(x * k for x, k in best.items())
    if not left:
        return best
    every, reach = (2 << room) - 1, [1]
    for x in reversed(lengths):
        sums = reach[-1]
        for k in _copies(min(room // x, counts[x])):
            sums |= sums << k * x & every
        reach.append(sums)
    reach.reverse()
    goal = reach[0].bit_length() - 1
    if room - goal >= left:
        return best
    best = Counter()
    for i, x in enumerate(lengths):
        for k in range(min(goal // x, counts[x]), 0, -1):
            if reach[i + 1] >> goal - k * x & 1:
                best[x], goal = k, goal - k * x
                break
    return best


def dominated(filling: dict[int, int], left: int, others: int) -> bool:
    """Whether one of ``others``, bits of the lengths outside, can stand for pieces of a filling with room ``left``.

    It can where the pieces, or none of them, fit into the other's length and the other fits into their room and what is
    left: then any plan can swap the two, and the bin is fuller, or as full with fewer pieces.
    """
    sums, several = 1, 0  # of any pieces, of two or more
    for y, n in filling.items():
        for k in _copies(n):
            several |= several << k * y | (sums & ~1) << k * y | (1 << k * y if k > 1 else 0)
            sums |= sums << k * y
    wider, width = sums, 1  # sums and up to width - 1 more
    while width < left:
        step = min(width, left - width)
        wider, width = wider | wider << step, width + step
    return bool(others & (several | (wider << 1 if left else 0)))


Plan = list[tuple[int, int, int, int, int, int]]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """Rows (length, first rank, end rank, pieces a bin, first bin, offset) that place every piece.

    The plan of best fit and that of least waste a bin are the incumbents; the search over whole plans replaces them
    where it needs fewer bins.  It ends at the lower bound, when nothing is left to try, or after ``steps``: the plan
    has the fewest bins possible unless the steps ran out.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    best = min(_complete(counts, capacity, complete_bin), _complete(counts, capacity, _best_fit), key=_bins)
    return _rows(_search(counts, capacity, best, steps))


Uses = list[tuple[dict[int, int], int]]


def _bins(uses: Uses) -> int:
    return sum(times for _, times in uses)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No plan has fewer bins: pieces over half stand apart, and those of ``least`` or more fill only the room they leave."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    number, weight = np.zeros(capacity + 2, int), np.zeros(capacity + 2, int)
    for x, n in counts.items():
        number[x + 1], weight[x + 1] = n, x * n
    number, weight, half = number.cumsum(), weight.cumsum(), capacity // 2  # of pieces below x, at x
    for least in [x for x in counts if x <= half]:
        apart = int(number[-1] - number[half + 1])
        room = int(number[capacity - least + 1] - number[half + 1]) * capacity - int(weight[capacity - least + 1] - weight[half + 1])
        best = max(best, apart + max(0, -(-(int(weight[half + 1] - weight[least]) - room) // capacity)))
    return max(best, int(number[-1] - number[half + 1]))


class _Spent(Exception):
    pass


def _search(counts: dict[int, int], capacity: int, best: Uses, steps: int) -> Uses:
    """Branch and bound: every undominated filling of the largest length left, often first and then once, in turn.

    A plan with a dominated filling can be changed into one with another without more bins, so it needs no look.  A branch is left when
    its waste leaves no plan with fewer bins than the incumbent, or when the same pieces were left over before.
    """
    counts, total, least = dict(counts), sum(x * n for x, n in counts.items()), lower_bound(counts, capacity)
    fewest, waste, used = _bins(best), 0, 0
    seen: set[bytes] = set()
    spare = lambda: (fewest - 1) * capacity - total - waste

    def fillings() -> Iterator[dict[int, int]]:
        x = max(counts)
        held = counts | {x: counts[x] - 1}
        lengths = sorted((y for y, n in held.items() if n and y <= capacity - x), reverse=True)
        tail = [0] * (len(lengths) + 1)
        for i in range(len(lengths) - 1, -1, -1):
            tail[i] = min(capacity, tail[i + 1] + lengths[i] * held[lengths[i]])
        every = sum(1 << y for y in lengths)
        chosen: dict[int, int] = {}

        def go(i: int, left: int) -> Iterator[None]:
            nonlocal used
            used += 1
            if used > steps:
                raise _Spent
            for j in range(i, len(lengths)):
                if left - tail[j] > spare():
                    return
                y = lengths[j]
                for k in range(min(left // y, held[y]), 0, -1):
                    chosen[y] = k
                    yield from go(j + 1, left - k * y)
                    del chosen[y]
            if left <= spare() and not dominated(chosen, left, every - sum(1 << y for y, k in chosen.items() if k == held[y])):
                yield

        for _ in go(0, capacity - x):
            yield chosen | {x: chosen.get(x, 0) + 1}

    def uses() -> Iterator[tuple[dict[int, int], int]]:
        for f in fillings():
            most = min(counts[y] // k for y, k in f.items())
            yield from ((f, times) for times in dict.fromkeys((most, 1)))

    def put(f: dict[int, int], times: int) -> None:
        nonlocal waste
        for y, k in f.items():
            counts[y] = counts.get(y, 0) - k * times
            if not counts[y]:
                del counts[y]
        waste += times * (capacity - sum(y * k for y, k in f.items()))

    if fewest <= least:
        return best
    path: Uses = []
    stack = [uses()]
    try:
        while stack:
            if (move := next(stack[-1], None)) is None:
                stack.pop()
                if path:
                    f, times = path.pop()
                    put(f, -times)
                continue
            put(*move)
            path.append(move)
            if not counts and _bins(path) < fewest:
                best, fewest = list(path), _bins(path)
                if fewest <= least:
                    break
            state = hashlib.blake2b(repr(sorted(counts.items())).encode(), digest_size=16).digest()
            if not counts or spare() < 0 or state in seen:
                f, times = path.pop()
                put(f, -times)
                continue
            seen.add(state)
            stack.append(uses())
    except _Spent:
        pass
    return best


def _complete(counts: dict[int, int], capacity: int, fill: Callable[[dict[int, int], list[int], int], Counter]) -> Uses:
    """Fillings and how often each is used: the bin around the largest length is completed, turn by turn.

    Each turn uses a filling as often as the counts allow and so ends with too few of at least one length for another
    use; the number of turns is bounded by the capacity and the logarithm of the counts.
    """
    counts, uses = dict(counts), []
    while counts:
        lengths = sorted(counts, reverse=True)
        x = lengths[0]
        counts[x] -= 1
        filling = fill(counts, [y for y in lengths if y <= capacity - x and counts[y]], capacity - x)
        counts[x] += 1
        filling[x] += 1
        times = min(counts[y] // k for y, k in filling.items())
        uses.append((dict(filling), times))
        for y, k in filling.items():
            counts[y] -= k * times
            if not counts[y]:
                del counts[y]
    return uses


def _rows(uses: Uses) -> Plan:
    taken, rows, bins = Counter(), [], 0
    for filling, times in uses:
        offset = 0
        for y, k in sorted(filling.items(), reverse=True):
            rows.append((y, taken[y], taken[y] + k * times, k, bins, offset))
            taken[y] += k * times
            offset += k * y
        bins += times
    return rows


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    Null and empty texts are the separator alone.  Longer documents than ``capacity`` are cut so that only the first
    piece is shorter; no other document is cut.  Repeated rows are packed as often as they come.  An empty table gives
    an empty result.  Needs doc_id and text only.
    """
    cut = _pieces(tokenizer or vocabulary_path(), capacity, keep_ids)
    pieces = materialise(map_texts(docs, cut, PIECES + (", ids binary" if keep_ids else "")), "pieces")
    # The rank of a piece within its length: its place in the task that cut it, after all that earlier tasks cut.
    cells = materialise(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "cells")
    ahead = cells.withColumn("ahead", F.expr("sum(n) over (partition by length order by task rows between unbounded preceding and current row) - n"))
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(plan_bins(counts, capacity), "length long, low long, high long, k long, bin long, at long")
    ranked = pieces.join(ahead.drop("n"), ["length", "task"]).withColumn("rank", F.col("ahead") + F.col("slot"))
    placed = ranked.join(F.broadcast(plan), "length").where("rank >= low and rank < high")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", F.expr("bin + (rank - low) div k").alias("sequence_id"), F.expr("at + (rank - low) % k * length").alias("offset")]
    return placed.select(*out, *(["ids"] if keep_ids else []))
