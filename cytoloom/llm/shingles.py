"""Word shingles of whole texts as 64-bit hashes, a buffer of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text that are hashed together; bounds the temporary arrays to about forty times as much.
BUFFER = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(start: int, n: int) -> np.ndarray:
    return mix(np.arange(start + 1, start + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word: the sum of its bytes, each weighted by its place in the word."""
    buf = np.frombuffer(raw, np.uint8)
    space = SPACE[buf]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(buf)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(buf)]))
    value = np.where(space, 0, buf.astype(np.uint64) + np.uint64(1)) * _weights(0, int(place.max()) + 1)[place]
    return mix(np.add.reduceat(value, starts)), starts


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """All k-word shingles of a run of words; of fewer words the whole run, salted by its length."""
    n = min(k, len(words))
    if not n:
        return words
    weights = _weights(1 << 20, k)
    total = np.full(len(words) - n + 1, np.uint64(0 if n == k else n * 0xD6E8FEB86659FD93 % 2**64))
    for i in range(n):
        total = total + words[i : len(words) - n + 1 + i] * weights[i]
    return mix(total)


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; A-Z count as lower case, null and blank texts have none."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode().lower())
        size += len(held[-1]) + 1
        if size >= BUFFER:
            yield from _flush(held, k)
            held, size = [], 0
    yield from _flush(held, k)


def _flush(held: list[bytes], k: int) -> Iterator[np.ndarray]:
    ends = np.cumsum([len(b) + 1 for b in held], dtype=np.int64)
    words, starts = _words(b" ".join(held) + b" ")
    edges = np.r_[0, np.searchsorted(starts, ends)]
    for a, b in zip(edges[:-1], edges[1:]):
        yield np.unique(_shingles(words[a:b], k))
