"""Suffix arrays by linear grouping construction, without recursive renaming.

First the suffixes are grouped by their longest Lyndon prefix.  Groups begin as the suffixes of one first symbol and
are taken in descending order.  A suffix of the group at hand hangs on its previous smaller suffix, the nearest one to
its left that is in a lower group; these parents move, within their own groups, behind the rest, those with more
children in the group farther, and so their groups split.  When all groups are done their order is final, and one
sweep upwards over the array emits the order inside each group: a suffix that is placed pulls the suffix to its left, and
along the pointers all that hang together, to the next free place of their groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes in order.  Symbols are integers from 0 on; the last must be 0 and stand nowhere else."""
    n = len(text)
    if n < 2:
        return list(range(n))
    counts = Counter(text)
    start_of, place = {}, 0
    for symbol in sorted(counts):
        start_of[symbol] = place
        place += counts[symbol]
    group = [start_of[x] for x in text]  # the start of a suffix's group in the array
    size = [0] * n
    for symbol, k in counts.items():
        size[start_of[symbol]] = k
    array, where, free = [0] * n, [0] * n, dict(start_of)
    for i, x in enumerate(text):
        where[i] = free[x]
        array[where[i]] = i
        free[x] += 1
    before = [-2] * n  # previous smaller suffix; -2 is not known yet, -1 is none
    end = n
    while end > 1:
        start = group[array[end - 1]]
        members = sorted(array[start:end])
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j] if before[j] != -2 else j - 1
            before[i] = j
        children = Counter(before[i] for i in members)
        children.pop(-1, None)
        # By falling number of children, the parents of each group become the last part of what is left of it.
        by_count: dict[int, list[int]] = {}
        for parent, k in children.items():
            by_count.setdefault(k, []).append(parent)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for parent in by_count[k]:
                moved.setdefault(group[parent], []).append(parent)
            for g, parents in moved.items():
                if len(parents) == size[g]:
                    continue
                new = g + size[g] - len(parents)
                put = g + size[g]
                for parent in parents:
                    put -= 1
                    # swap the parent with what stands at the end of its group
                    at, other = where[parent], array[put]
                    array[at], array[put] = other, parent
                    where[other], where[parent] = at, put
                for parent in parents:
                    group[parent] = new
                size[new] = len(parents)
                size[g] -= len(parents)
        end = start
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    next_free = list(range(n))
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            out[next_free[group[j]]] = j
            next_free[group[j]] += 1
            j = before[j]
    return out


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """For each place of the array how many symbols its suffix shares with the one before; 0 for the first."""
    n = len(text)
    rank, shared, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            shared[rank[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    return shared
