"""Sorted suffixes of a sequence of symbols: order, common prefixes, range minima, next smaller values, runs.

Sequences are arrays of 64-bit integers whose last symbol occurs nowhere else, so that no suffix is another's prefix.
All steps work on whole arrays; their memory is a small multiple of n log n numbers, so callers hand over portions of
bounded size.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of all suffixes in order, and the ranks by their first 1, 2, 4, ... symbols (prefix doubling).

    Ties in rank are suffixes that agree so far; only these are sorted on. With ``depth``, suffixes that agree in at
    least so many symbols may stay in any order.
    """
    n, width = len(symbols), 1
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n + 1, bool)
    new[1:n] = symbols[order[1:]] != symbols[order[:-1]]
    ranks = np.empty(n, np.int64)
    ranks[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    levels = [ranks.astype(np.int32)]
    while not depth or width < depth:
        open_ = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(open_):
            break
        at = order[open_]
        keys = ranks[at] * n + ranks[at + width]
        by = np.argsort(keys, kind="stable")
        keys, at = keys[by], at[by]
        order[open_] = at
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        new[open_] = first
        ranks[at] = np.maximum.accumulate(np.where(first, open_, 0))
        width *= 2
        levels.append(ranks.astype(np.int32))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each suffix in order, the symbols that it has in common with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[k][a] == levels[k][b])
        a[same] += 1 << k
        b[same] += 1 << k
        out[1 + same] += 1 << k
    return out


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: minima over all ranges of 1, 2, 4, ... values."""
    table = [values]
    while 2 * (half := 1 << (len(table) - 1)) <= len(values):
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def range_minimum(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of the ranges from ``low`` to ``high``, both included and not empty."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] + 1 - (1 << int(k))])
    return out


def next_smaller(values: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The next place with a smaller value, for each place; n where there is none. Values are distinct and not negative.

    Places jump to where their own next candidate already points, which settles nearly all of them; the rest look
    ahead in a sparse table.
    """
    n = len(values)
    ended = np.append(values, -1)
    out = np.arange(1, n + 2)
    left = np.flatnonzero(ended[1:] > ended[:-1])
    for _ in range(rounds):
        out[left] = out[out[left]]
        left = left[ended[out[left]] > ended[left]]
        if not len(left):
            return out[:n]
    table, at, own = minima(ended), out[left], ended[left]
    for k in range(len(table) - 1, -1, -1):
        fits = at + (1 << k) <= n + 1
        ahead = table[k][np.where(fits, at, 0)]
        at = np.where(fits & (ahead > own), at + (1 << k), at)
    out[left] = at
    return out[:n]


def runs(symbols: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs with at least ``min_length`` symbols and ``min_exponent`` (3 or more) periods.

    By the runs theorem every run has, under one of the two orders of symbols, a root that is the longest Lyndon word
    from its place: it ends before the next smaller suffix, that is the next smaller value of the inverse suffix array
    (or of its mirror image). Roots that come again are extended to both sides by common prefixes of suffixes, each the
    minimum of a range; to the left by bisection, as the part that agrees is a suffix of the period before.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods may share their roots")
    n, found = len(symbols), []
    order, levels = sorted_suffixes(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    table: list[np.ndarray] = []

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not table:
            table.extend(minima(common_prefixes(order, levels)))
        a, b = place[i], place[j]
        return range_minimum(table, np.minimum(a, b) + 1, np.maximum(a, b)).astype(np.int64)

    for ranks in (place, n - 1 - place):
        i = np.arange(n)
        p = next_smaller(ranks) - i
        reach = (min_exponent - 2) * p + 1  # the first root of a run lies less than a period behind its start
        i = np.flatnonzero(i + p + reach <= n)
        p, reach = p[i], reach[i]
        same = np.flatnonzero((symbols[i] == symbols[i + p]) & (symbols[i + reach - 1] == symbols[i + p + reach - 1]))
        i, p, reach = i[same], p[same], reach[same]
        if not len(i):
            continue
        right = agree(i, i + p)
        held = np.flatnonzero(right >= reach)
        i, p, right = i[held], p[held], right[held]
        first = np.flatnonzero(~np.isin((i - p) * (n + 1) + p, i * (n + 1) + p))  # else the root one period before is there too
        i, p, right = i[first], p[first], right[first]
        low, high = np.zeros(len(i), np.int64), np.minimum(p - 1, i)
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = agree(i - mid, i + p - mid) >= mid
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        found.append(np.stack([i - low, low + p + right, p]))
    start, length, period = np.unique(np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1), axis=1)
    good = length >= np.maximum(min_length, min_exponent * period)
    return start[good], length[good], period[good]
