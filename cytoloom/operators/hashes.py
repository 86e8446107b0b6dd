"""md5 and xxhash64 of many short texts of one length at once."""

from __future__ import annotations

import numpy as np

#: Texts that are hashed at once, so that what is at hand stays in the cache; longest texts that take one round.
ROWS, LONGEST_MD5, LONGEST_XXHASH = 1 << 13, 55, 31
SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _md5(letters: np.ndarray) -> np.ndarray:
    n, k = letters.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :k], block[:, k] = letters, 0x80
    words = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32)
    words[14] = 8 * k
    start = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + SINES[i] + words[g]
        turn = TURNS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return np.stack([x + y for x, y in zip(start, (a, b, c, d))], 1).astype("<u4").view(">u8").astype(np.uint64)


def md5(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of the digest of each row of bytes, as big-endian numbers; at most 55 bytes a row."""
    parts = [_md5(letters[i : i + ROWS]) for i in range(0, len(letters), ROWS)]
    both = np.concatenate(parts or [np.zeros((0, 2), np.uint64)])
    return both[:, 0], both[:, 1]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def xxhash64(letters: np.ndarray, seed: int = 42) -> np.ndarray:
    """The hash of each row of bytes, as Spark's function with its seed; at most 31 bytes a row."""
    n, k = letters.shape
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :k] = letters
    longs, ints = padded.view("<u8").astype(np.uint64), padded.view("<u4").astype(np.uint64)
    h, at = np.full(n, (seed + int(P5) + k) % 2**64, np.uint64), 0
    while at + 8 <= k:
        h = _turned(h ^ _turned(longs[:, at // 8] * P2, 31) * P1, 27) * P1 + P4
        at += 8
    if at + 4 <= k:
        h = _turned(h ^ ints[:, at // 4] * P1, 23) * P2 + P3
        at += 4
    for i in range(at, k):
        h = _turned(h ^ padded[:, i].astype(np.uint64) * P5, 11) * P1
    h = (h ^ h >> np.uint64(33)) * P2
    h = (h ^ h >> np.uint64(29)) * P3
    return h ^ h >> np.uint64(32)
