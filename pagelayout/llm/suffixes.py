"""Suffix arrays by linear grouping: Lyndon-prefix groups first, then the order inside them."""

from __future__ import annotations

import numpy as np


def group_suffixes(text: np.ndarray) -> tuple[list[int], list[int]]:
    """(start, pointer): for each suffix the first slot of its group, and its previous suffix in a lower group (-1: none).

    Groups begin as suffixes of one first letter, in slots of one array. They are taken in descending order. Each member points to the
    nearest suffix to its left that lies in a lower group; those left suffixes that have the same number of members pointing at
    them, and share a group, leave it for a new group just above it, more pointers higher. In the end suffixes of one group
    share their longest Lyndon prefix, and groups stand in the order of these prefixes. No letters are renamed.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    slot = np.empty(n, dtype=np.int64)
    slot[order] = np.arange(n)
    letters = text[order]
    firsts = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    start = np.repeat(firsts, np.diff(np.append(firsts, n)))
    end_of = dict(zip(firsts.tolist(), np.append(firsts[1:], n).tolist()))
    by_slot, slot = order.tolist(), slot.tolist()
    group = start[slot].tolist()
    pointer = [-1] * n
    high = n
    while high:
        low = group[by_slot[high - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(by_slot[low:high]) if high - low > 1 else (by_slot[low],):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                parts.setdefault((times, group[j]), []).append(j)
            for times, g in sorted(parts, reverse=True) if len(parts) > 1 else parts:
                moved, end = parts[times, g], end_of[g]
                first = end - len(moved)
                if first == g:
                    continue  # the whole group moves: it stays as it is
                for k, j in enumerate(moved, first):
                    other, at = by_slot[k], slot[j]
                    by_slot[at], slot[other] = other, at
                    by_slot[k], slot[j] = j, k
                for j in moved:
                    group[j] = first
                end_of[first], end_of[g] = end, first
        high = low
    return group, pointer


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; the last letter must be the smallest and unique.

    Walks the array from its first slot: the suffix one before an emitted one, then along the pointers, takes the next free slot of its
    group, until one is met that has its slot.
    """
    group, pointer = group_suffixes(text)
    n = len(text)
    free = list(range(n))
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = pointer[j]
    return np.array(out, dtype=np.int64)
