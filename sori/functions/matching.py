"""Longest common pieces of pairs of texts, for whole batches of pairs at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters of quotes and sources that are searched together.
PORTION = 1_000_000
#: From this length on, characters that make up more than a hundredth of a source (and one) start no piece.
LONG, RARE = 200, 100
BASE = 0x9E3779B97F4A7C15


def _joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after another, and where each begins (and all end)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


class _Side:
    """Texts of one side: their characters, and hashes of all pieces of a given length that hold no barred character."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, barred: np.ndarray):
        self.codes, self.starts = codes, starts
        self.owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), BASE, np.uint64)]))
        self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(codes), pow(BASE, -1, 1 << 64), np.uint64)]))
        value = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((value ^ (value >> np.uint64(29))) * powers[:-1], dtype=np.uint64)])
        self.bars = np.concatenate([[0], np.cumsum(barred)])

    def pieces(self, length: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes (of pair and piece) of the pieces of ``length[pair]`` characters in the pairs that are ``wanted``."""
        at = np.flatnonzero(wanted[self.owner])
        end = at + length[self.owner[at]]
        fits = np.flatnonzero(end <= self.starts[self.owner[at] + 1])
        at, end = at[fits], end[fits]
        free = self.bars[end] == self.bars[at]
        at, end = at[free], end[free]
        h = (self.sums[end] - self.sums[at]) * self.back[at]
        return at, (h ^ (h >> np.uint64(31))) * np.uint64(BASE) + self.owner[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def portions(quotes: Sequence[str], sources: Sequence[str]) -> Iterator[slice]:
    first = total = 0
    for k, n in enumerate(len(q) + len(s) for q, s in zip(quotes, sources, strict=True)):
        if total and total + n > PORTION:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if first < len(quotes):
        yield slice(first, len(quotes))


def longest_pieces(quotes: Sequence[str], sources: Sequence[str]) -> np.ndarray:
    """For each pair, the length of the longest piece of the quote that stands in the source.

    As sequence matchers have it: of the longest pieces without frequent characters of a long source, the first of the
    quote at its first place in the source is taken and extended to both sides by whatever characters agree; without
    such a piece, what both texts begin with. Lengths are found by bisection for all pairs of a portion together, as
    hashes of pieces that both sides have; the piece taken is then compared character by character.
    """
    out = [_longest(*_pair_up(quotes[part], sources[part]))[2] for part in portions(quotes, sources)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is one of ``known``, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _pair_up(quotes: Sequence[str], sources: Sequence[str]) -> tuple[np.ndarray, ...]:
    """Characters of both sides, where texts begin, and which characters may start no piece (frequent ones of long sources)."""
    a, a_at = _joined(quotes)
    b, b_at = _joined(sources)
    size = np.diff(b_at)
    far = np.flatnonzero(np.repeat(size >= LONG, size))  # only long sources have frequent characters
    letters, which, times = np.unique(np.repeat(np.arange(len(size)), size)[far] * 0x110000 + b[far], return_inverse=True, return_counts=True)
    frequent = times > size[letters // 0x110000] // RARE + 1
    barred = np.zeros(len(b), bool)
    barred[far] = frequent[which]
    own = np.repeat(np.arange(len(size)), np.diff(a_at)) * 0x110000 + a
    return a, a_at, _among(own, letters[frequent]), b, b_at, barred


def _longest(a: np.ndarray, a_at: np.ndarray, a_barred: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_barred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in a, place in b and length of each pair's longest piece, extended."""
    pairs = len(a_at) - 1
    left, right = _Side(a, a_at, a_barred), _Side(b, b_at, b_barred)
    low, high = np.zeros(pairs, np.int64), np.minimum(np.diff(a_at), np.diff(b_at))
    while (todo := low < high).any():
        mid = (low + high + 1) // 2
        at, found = left.pieces(mid, todo)
        hit = np.zeros(pairs, bool)
        hit[left.owner[at[_among(found, np.sort(right.pieces(mid, todo)[1]))]]] = True
        low, high = np.where(todo & hit, mid, low), np.where(todo & ~hit, mid - 1, high)
    i, j = a_at[:-1].copy(), b_at[:-1].copy()
    at, found = left.pieces(low, low > 0)
    there, known = right.pieces(low, low > 0)
    by = np.argsort(known, kind="stable")
    known, there = known[by], there[by]
    shared = _among(found, known)
    at, found = at[shared], found[shared]
    own, lead = np.unique(left.owner[at], return_index=True)
    i[own] = at[lead]
    j[own] = there[np.searchsorted(known, found[lead])]
    end = i + low
    todo = np.arange(pairs)
    while len(todo := todo[(i[todo] > a_at[todo]) & (j[todo] > b_at[todo])]):
        todo = todo[a[i[todo] - 1] == b[j[todo] - 1]]
        i[todo] -= 1
        j[todo] -= 1
    ahead, todo = j + (end - i), np.arange(pairs)
    while len(todo := todo[(end[todo] < a_at[todo + 1]) & (ahead[todo] < b_at[todo + 1])]):
        todo = todo[a[end[todo]] == b[ahead[todo]]]
        end[todo] += 1
        ahead[todo] += 1
    return i, j, end - i


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of ranges one after another, and where each range begins among them (and all end)."""
    ends = np.concatenate([[0], np.cumsum(high - low)])
    return np.repeat(low - ends[:-1], high - low) + np.arange(ends[-1]), ends


def matched_characters(quotes: Sequence[str], sources: Sequence[str]) -> np.ndarray:
    """For each pair, the characters in matching blocks: the longest piece, then those of what is before and behind it, and so on.

    The parts of all pairs that are left in one step are searched together.
    """
    out = [_blocks(quotes[part], sources[part]) for part in portions(quotes, sources)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blocks(quotes: Sequence[str], sources: Sequence[str]) -> np.ndarray:
    a, a_at, a_barred, b, b_at, b_barred = _pair_up(quotes, sources)
    total = np.zeros(len(a_at) - 1, np.int64)
    pair, a_low, a_high, b_low, b_high = np.arange(len(total)), a_at[:-1], a_at[1:], b_at[:-1], b_at[1:]
    while len(pair):
        at, a_begin = _ranges(a_low, a_high)
        there, b_begin = _ranges(b_low, b_high)
        i, j, size = _longest(a[at], a_begin, a_barred[at], b[there], b_begin, b_barred[there])
        np.add.at(total, pair, size)
        some = np.flatnonzero(size)
        i, j, size, pair = (i - a_begin[:-1] + a_low)[some], (j - b_begin[:-1] + b_low)[some], size[some], pair[some]
        a_low, a_high = np.concatenate([a_low[some], i + size]), np.concatenate([i, a_high[some]])
        b_low, b_high = np.concatenate([b_low[some], j + size]), np.concatenate([j, b_high[some]])
        pair = np.concatenate([pair, pair])
        open_ = np.flatnonzero((a_low < a_high) & (b_low < b_high))
        pair, a_low, a_high, b_low, b_high = pair[open_], a_low[open_], a_high[open_], b_low[open_], b_high[open_]
    return total
