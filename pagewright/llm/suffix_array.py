"""Suffix arrays of integer texts by the difference-cover algorithm of period 3, in array steps.

Sampled suffixes (positions not divisible by 3) are sorted by their first three characters and named; where names
repeat, the sequence of names is sorted the same way. The other suffixes follow from one character and the rank of
the suffix after it, and both lists are merged by the two comparisons that a cover of period 3 needs.
"""

from __future__ import annotations

import numpy as np


def _keys(*columns: np.ndarray) -> np.ndarray | None:
    """The columns as one key, the first one weighing most; none if they do not fit."""
    bits = [int(c.max(initial=0)).bit_length() or 1 for c in columns]
    if sum(bits) > 63:
        return None
    key = columns[0].astype(np.uint32 if sum(bits) <= 32 else np.int64)
    for c, b in zip(columns[1:], bits[1:], strict=True):
        key <<= b
        key |= c.astype(key.dtype)
    return key


def _sorted(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and where a row in it differs from the one before."""
    key = _keys(*columns)
    order = np.lexsort(columns[::-1]) if key is None else np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns if key is None else [key]:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


def _pair(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    return a.astype(np.int64) * base + b


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of the suffixes of s in order; s has non-negative integers, the end of the text sorts before all.

    With a depth, suffixes that agree in so many characters may stand in any order. Names of three characters are then
    sorted to a third of it, so that the recursion ends early; what is merged between two such suffixes agrees with both.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.zeros(n + 6, np.int32)
    t[:n] = s
    t[:n] += 1
    extra = n % 3 == 1  # so that the names of positions 1 mod 3 end with one for the empty triple
    ones, twos, zeros = len(range(1, n + extra, 3)), len(range(2, n, 3)), len(range(0, n, 3))
    thirds = lambda x, k, m: x[k::3][:m]
    # each sampled suffix has a number, first those of positions 1 mod 3
    order, new = _sorted(*(np.concatenate([thirds(t, 1 + k, ones), thirds(t, 2 + k, twos)]) for k in range(3)))
    named = np.cumsum(new, dtype=np.int32)
    if named[-1] < len(order) and (depth is None or depth > 3):
        names = np.empty(len(order), np.int32)
        names[order] = named
        order = suffix_array(names, depth and -(-depth // 3))
    rank = np.zeros(n + 8, np.int32)
    ranks = np.empty(len(order), np.int32)
    ranks[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    thirds(rank, 1, ones)[:], thirds(rank, 2, twos)[:] = ranks[:ones], ranks[ones:]
    # where each suffix of the second list goes among the sampled ones
    base = len(order) + 2
    wide = int(t.max()) + 1
    by_one = _pair(thirds(t, 0, zeros), thirds(rank, 1, zeros), base)
    by_two = _pair(_pair(thirds(t, 0, zeros), thirds(t, 1, zeros), wide), thirds(rank, 2, zeros), base)
    zero = np.argsort(by_one)
    first = order[order < ones - extra]
    second = order[order >= ones] - ones
    before = np.searchsorted(_pair(thirds(t, 1, ones), thirds(rank, 2, ones), base)[first], by_one[zero])
    before += np.searchsorted(_pair(_pair(thirds(t, 2, twos), thirds(t, 3, twos), wide), thirds(rank, 4, twos), base)[second], by_two[zero])
    out = np.empty(n, np.int64)
    at = np.maximum.accumulate(before) + np.arange(zeros)  # only suffixes that agree to the depth can be out of step
    free = np.ones(n, bool)
    free[at] = False
    out[at] = 3 * zero
    p = np.where(order < ones, 3 * order + 1, 3 * (order - ones) + 2)
    out[free] = p[p < n] if extra else p
    return out
