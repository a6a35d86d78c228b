"""Fuzzy line deduplication: sketches of n-grams, edit similarity of candidates, connected groups."""

from __future__ import annotations

import string
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sori.llm.graph import components
from sori.llm.minhash import GOLD, mix
from sori.llm.store import cut, drop_table, heavy, settings, small_batches

#: Bytes (UTF-8, after normalising) from which lines count at all, and from which they are also compared with unequal ones.
MIN_BYTES, FUZZY_BYTES = 11, 20
#: Lines of so many words count and are compared even if they have fewer bytes.
MIN_WORDS = 5
#: Sketches of lines of so many characters: (unit, units in an n-gram, from, to, permutations in a key, keys). Ranges overlap by
#: the tenth that similar lines may differ in length. Long lines have keys of two kinds, as edits scattered over a line spare
#: the one or the other: a word counts by its first letter only, which edits inside words leave alone; letters are bytes
#: without spaces, which edits at spaces leave alone. Lines of more than WIDE characters a word have the tier "wide" instead.
TIERS = (("bytes", 3, 1, 30, 3, 28), ("bytes", 5, 27, 64, 3, 28), ("letters", 14, 57, 130, 1, 20), ("words", 8, 117, 1 << 62, 1, 7), ("wide", 12, 117, 1 << 62, 2, 10), ("letters", 16, 117, 1 << 62, 1, 7))
KEYS, SLOTS, WIDE = 28, 4, 10
#: N-grams of a line, about, that keys of 16 letters are chosen from: those with the smallest hashes, of lines of like length mostly
#: the same. Lines with fewer than LEAST_SAMPLE of these (all repetitions) use all.
SAMPLE, LEAST_SAMPLE = 64, 16
#: Of 16 marks of second and third letters of the words of a shared n-gram, so many may differ; unrelated lines mostly differ in more.
MARKS = 6
#: The place of an n-gram that may lie anywhere in a line.
ANYWHERE = 0xFFFF
#: Groups of up to so many lines leave out members that fit none but the group's lead.
SMALL_GROUP = 512
#: Bytes of text whose lines' keys make one part, about. Members of a group that meet in one block. Bytes and pairs of members in a task, about.
PART_BYTES, JOB_LINES, JOB_BYTES, JOB_PAIRS = 16_000_000, 1000, 16_000_000, 1_500_000
#: Lists that a task gathers in memory before it sorts.
GROUPS = 100_000
#: Lowest bits of a key that hold its slot: two lines share a key only in one slot.
SLOT_BITS = 7
#: The lower half of a line's key (the part has the rest; the lowest bits are the slot), its marks (0: none), the line, its characters and the key's place (both at most ANYWHERE).
ENTRY = np.dtype([("key", "<u4"), ("marks", "<u4"), ("line", "<i8"), ("chars", "<u2"), ("place", "<u2")])
#: A line, and where it stands: document, its number, number of the line.
SEEN = np.dtype([("line", "<i8"), ("doc_id", "<i8"), ("row", "<i8"), ("line_no", "<i4")])
#: Words in which an alignment looks for the next equal ones, and how many of these on end, in turn.
AHEAD = ((16, 2), (1024, 2), (16, 1))
#: Lines whose :func:`distances` are not above this are mostly similar, which an alignment by words then shows fastest.
ALIGNED = 0.3
#: Edit similarity, 1 - distance / longer length, that linked lines reach.
EDIT_SIMILARITY = 0.9
#: Bytes that normalising leaves out, and white space other than the space.
DROP = bytes(c for c in range(256) if chr(c) in string.punctuation)
SPACES = bytes.maketrans(b"\t\r\x0b\x0c", b"    ")
RANDOM = np.random.default_rng(8)
#: A number for each byte (for each of a letter's first three bytes), and odd multipliers that stand for the permutations.
LETTERS = RANDOM.integers(1, 2**63, (3, 256)).astype(np.uint64)
FACTORS = RANDOM.integers(1, 2**63, (KEYS, 3)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(GOLD)


def normalise(text: str) -> list[bytes]:
    """The lines of a text in lower case, without ASCII punctuation, with one space between words."""
    lines = text.lower().encode("utf-8", "replace").translate(SPACES, DROP).split(b"\n")
    return [b" ".join(x.split()) if b"  " in x or x[:1] == b" " or x[-1:] == b" " else x for x in lines]


def counts(line: bytes, least: int) -> bool:
    """Whether a normalised line has enough bytes or enough words."""
    return len(line) >= least or line.count(b" ") >= MIN_WORDS - 1


def powers(n: int, known: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of BASE and of its inverse, modulo 2^64."""
    if not known or len(known[0]) < n:
        known[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16), x % (1 << 64), np.uint64)]) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return known[0], known[1]


def ngrams(codes: np.ndarray, starts: np.ndarray, amounts: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, still to be mixed, of the stretches of ``q`` codes (of all, if there are fewer) of each line, and where each line's begin."""
    power, inverse = powers(len(codes) + 1)
    before = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=before[1:])
    n = np.maximum(amounts - q + 1, 1)
    first = np.cumsum(n) - n
    if len(amounts) and amounts.min() >= q:
        at = np.arange(int(n.sum())) + np.repeat(starts - first, n)
        return (before[at + q] - before[at]) * inverse[at], first
    at = np.arange(int(n.sum())) + np.repeat(starts - first, n)
    return (before[at + np.repeat(np.minimum(amounts, q), n)] - before[at]) * inverse[at], first


def sampled(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The n-grams among which a line's keys are chosen, as ascending numbers: those of the smallest hashes, SAMPLE or so a line."""
    n = np.diff(np.r_[first, len(h)])
    limit = np.full(len(n), np.uint64((1 << 64) - 1))
    limit[n > SAMPLE] = (SAMPLE / n[n > SAMPLE] * 2.0**64).astype(np.uint64)
    some = h <= np.repeat(limit, n)
    few = np.add.reduceat(some, first, dtype=np.int64) < np.minimum(LEAST_SAMPLE, n)
    return np.flatnonzero(some | np.repeat(few, n)) if few.any() else np.flatnonzero(some)


def word_codes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word, of its first letter, the place of that letter in the joined lines, four bits of the next two bytes, and the number of words of each line."""
    buf = np.frombuffer(b" ".join(lines) + b"   ", np.uint8)
    ends = np.flatnonzero(buf[:-2] == 32)
    begins = np.r_[0, ends[:-1] + 1]
    head = buf[begins]
    code = LETTERS[0][head]
    wide = np.flatnonzero(head >= 0xC0)  # letters of two bytes or three
    code[wide] += LETTERS[1][buf[begins[wide] + 1]] + LETTERS[2][buf[begins[wide] + 2]] * (head[wide] >= 0xE0)
    second = buf[begins + 1]
    marks = (second * np.uint8(0x9D) >> 6 & 3) << 2 | (np.where(second == 32, 0, buf[begins + 2]) * np.uint8(0x9D) >> 6 & 3)
    return mix(code), begins, marks.astype(np.uint64), np.array([x.count(b" ") + 1 for x in lines], np.int64)


def repeats(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether an n-gram occurs more than once in its line (a few that do are overlooked)."""
    bits = max(10, len(h).bit_length() + 1)
    slot = ((h + row.astype(np.uint64)) * GOLD) >> np.uint64(64 - bits)
    last = np.empty(1 << bits, np.int32)  # only places that are written are read
    last[slot] = np.arange(len(h), dtype=np.int32)
    other = last[slot]
    twice = (h == h[other]) & (row == row[other]) & (other != np.arange(len(h)))
    twice[other[twice]] = True
    return twice


def placed_sketches(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in characters, keys (lines x SLOTS x KEYS, 0 for none) for a line's tiers in turn, and each key's place and marks.

    A key holds the n-gram that comes first in one permutation, or in each of two or three. It agrees with the
    Jaccard coefficient of two lines' n-grams, or its power, as probability. The place is the character of the line
    that a key's only n-gram begins with; ANYWHERE for keys of several n-grams and for n-grams that occur more than once.
    Marks tell of the words of such an n-gram what its first letters leave out; 0 where there are none.
    """
    chars = np.array([len(x) if x.isascii() else len(x.decode("utf-8", "replace")) for x in lines], np.int64)
    spaces = np.array([x.count(b" ") for x in lines], np.int64)
    shape = (len(lines), SLOTS, KEYS)
    keys, places, marks = np.zeros(shape, np.uint64), np.full(shape, ANYWHERE, np.uint16), np.zeros(shape, np.uint32)
    wide = chars > WIDE * (spaces + 1)
    for t, (unit, q, low, high, permutations, count) in enumerate(TIERS):
        own = {"wide": wide, "words": spaces + 1 >= q}.get(unit, ~wide | (chars <= 130))  # few words make no n-gram that tells lines apart
        rows = np.flatnonzero((chars >= low) & (chars <= high) & own)
        if not len(rows):
            continue
        chosen = [lines[i] for i in rows]
        buf = np.frombuffer(b" ".join([*chosen, b""]), np.uint8)
        sizes = np.array([len(x) for x in chosen], np.int64)
        word_marks = None
        if unit == "words":
            codes, at, word_marks, amounts = word_codes(chosen)
        elif unit == "letters":
            at = np.flatnonzero(buf != 32)
            codes, amounts = LETTERS[0][buf[at]], sizes - spaces[rows]
        else:
            codes, amounts = LETTERS[0][np.frombuffer(b"".join(chosen), np.uint8)], sizes
        begins = np.cumsum(amounts) - amounts
        h, first = ngrams(codes, begins, amounts, q)
        placed = permutations == 1
        if placed:
            n = np.diff(np.r_[first, len(h)])
            some = sampled(h, first) if unit == "letters" else np.arange(len(h))
            row = np.repeat(np.arange(len(rows)), n)[some]
            starts = some + (begins - first)[row]  # of the n-grams, among the codes
            h, first = mix(h[some]), np.searchsorted(row, np.arange(len(rows)))
            again = repeats(h, row)
            nth = np.minimum(np.arange(len(h)) - first[row], ANYWHERE).astype(np.uint64)
            h &= np.uint64((1 << 64) - 1 - ANYWHERE)
        else:
            h = mix(h)
        least = np.empty((permutations, count, len(rows)), np.uint64)
        for k, factors in enumerate(FACTORS[:count]):
            for f, into in zip(factors, least[:, k], strict=False):
                v = h * f
                if placed:
                    v |= nth  # the lowest 16 bits are zero there
                np.minimum.reduceat(v, first, out=into)
        if placed:
            which = (least[0] & np.uint64(ANYWHERE)).astype(np.int64).T
            chosen_of = np.where(which < ANYWHERE, first[:, None] + which, -1)  # n-grams of each line's keys
            least >>= np.uint64(16)
        key = np.arange(t * KEYS + 1, t * KEYS + count + 1, dtype=np.uint64)[:, None]
        for part in least:
            key = mix(key * GOLD + part)
        keys[rows, t % SLOTS, :count] = key.T
        if placed:
            known = (chosen_of >= 0) & ~again[chosen_of]
            start = starts[chosen_of]
            before = at[start] if buf.max() < 128 else np.r_[0, np.cumsum((buf & 0xC0) != 0x80)][at[start]]  # characters before the n-gram's byte
            line_at = np.cumsum(chars[rows] + 1) - chars[rows] - 1
            place = before - line_at[:, None]
            places[rows, t % SLOTS, :count] = np.where(known & (place < ANYWHERE), place, ANYWHERE)
            if word_marks is not None:
                more = sum((word_marks[np.minimum(start + k, len(word_marks) - 1)] << np.uint64(4 * k) for k in range(q)), np.uint64(0))
                marks[rows, t % SLOTS, :count] = np.where(known, more, 0)
    return chars, keys, places, marks


def sketches(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in characters and keys, as of :func:`placed_sketches`."""
    return placed_sketches(lines)[:2]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel rows (one integer per row); may stop with any value above ``most``."""
    n = min(len(a), len(b))
    at = 0
    while at < n and a[at] == b[at]:
        at += 1
    a, b = a[at:], b[at:]
    while a and b and a[-1] == b[-1]:
        k = 1
        while k < min(len(a), len(b)) and a[-k - 1] == b[-k - 1]:
            k += 1
        a, b = a[:-k], b[:-k]
    if not a or not b:
        return len(a) + len(b)
    if abs(len(a) - len(b)) > most:
        return most + 1
    seen: dict[str, int] = {}
    for i, c in enumerate(a):
        seen[c] = seen.get(c, 0) | (1 << i)
    full, top, plus, minus, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for j, c in enumerate(b):
        eq = seen.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(zero | plus)) & full, plus & zero
        distance += 1 if up & top else -1 if down & top else 0
        if distance - (len(b) - j - 1) > most:
            return most + 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
        row = len(a) - len(b) + j + 1  # on the diagonal to the end, along which distances never fall
        if j & 15 == 15 and row > 0 and j + 1 + (plus & (1 << row) - 1).bit_count() - (minus & (1 << row) - 1).bit_count() > most:
            return most + 1
    return distance


def within(x: list[str], y: list[str], most: int) -> bool:
    """Whether one alignment by words (after each difference, at the next equal words) costs at most ``most`` edits.

    That alignment is an upper bound of the edit distance of the words joined by spaces, so True is sure, False is not.
    """
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            while x[i : i + 16] == y[j : j + 16] and i < len(x):
                i, j = i + 16, j + 16
            while i < len(x) and j < len(y) and x[i] == y[j]:
                i, j = i + 1, j + 1
            continue
        best = None
        for ahead, run in AHEAD:
            near, far = x[i : i + ahead], y[j : j + ahead]
            p, q = (zip(near, near[1:]), list(zip(far, far[1:]))) if run == 2 else (near, far)
            at = {w: e for e, w in reversed(list(enumerate(q)))}
            best = min(((d + at[w], d) for d, w in enumerate(p) if w in at), default=None)
            if best is not None:
                break
        if best is None:
            break
        d, e = best[1], best[0] - best[1]
        cost += edit_distance(" ".join([*x[i : i + d], ""]), " ".join([*y[j : j + e], ""]), most)
        if cost > most:
            return False
        i, j = i + d, j + e
    return cost + max(sum(map(len, x[i:])) + max(len(x) - i, 0), sum(map(len, y[j:])) + max(len(y) - j, 0)) <= most


def profile(text: str) -> np.ndarray:
    """Counts of a text's triples of characters, in bins."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount((c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) & np.uint32(1023), minlength=1024).astype(np.int16 if len(c) < 30_000 else np.int32)


def allowed(a: str, b: str) -> int:
    """Edits that two lines may differ by."""
    return int((1 - EDIT_SIMILARITY) * max(len(a), len(b)) + 1e-9)


def apart(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether two profiles differ by more than ``most`` edits can bring about."""
    net, gross = int(x.sum()) - int(y.sum()), int(np.abs(x - y).sum())
    return gross + abs(net) > 6 * most


def profiles(texts: list[str]) -> np.ndarray:
    """The profiles of many texts, one in a row."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "replace") + bytes(8), np.uint32)
    sizes = np.array([len(t) for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(row)) + 2 < np.repeat(np.cumsum(sizes), sizes)
    triples = (c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) & np.uint32(1023)
    return np.bincount((row * 1024 + triples)[inside], minlength=1024 * len(texts)).reshape(-1, 1024)


def binned(payloads: list[bytes]) -> tuple[list[str], np.ndarray]:
    """Texts and their profiles, each count 255 at most."""
    texts = [x.decode("utf-8", "replace") for x in payloads]
    bins = np.empty((len(texts), 1024), np.uint8)
    for at in range(0, len(texts), 256):
        bins[at : at + 256] = np.minimum(profiles(texts[at : at + 256]), 255)
    return texts, bins


def distances(chars: np.ndarray, bins: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How far pairs of :func:`binned` texts, of so many characters, are :func:`apart`: above 1 they are. Counts cut at 255 rule out no pair that is similar."""
    out = np.empty(len(left))
    for at in range(0, len(left), 2048):
        i, j = left[at : at + 2048], right[at : at + 2048]
        x, y = bins[i], bins[j]
        gross = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.uint32).astype(np.int64)
        most = 6 * (np.maximum(chars[i], chars[j]) // 10)
        out[at : at + 2048] = (gross + np.abs(chars[i] - chars[j])) / np.maximum(most, 1) + (most == 0) * 2.0
    return out


def near(left: list[str], right: list[str]) -> np.ndarray:
    """Whether the edit similarity of pairs of texts is high enough, many pairs at a time."""
    out = np.zeros(len(left), bool)
    m, n = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    most = np.maximum(m, n) // 10
    able = np.flatnonzero((np.abs(m - n) <= most) & (m > 0) & (n > 0))
    able = able[np.lexsort((n[able], m[able]))]
    at = 0
    while at < len(able):
        blocks = int(m[able[at]]) // 64 + 1
        to = at + max(1, min(2048, 8192 // blocks))
        to = at + int(np.searchsorted(m[able[at:to]], 1.5 * m[able[at]] + 64, "right"))  # of about one length
        rows = able[at:to]
        if len(rows) < 8 * (int(most[rows].max()) // 32 + 2):
            out[rows] = [settled(left[i], right[i]) for i in rows]
        else:
            out[rows] = side_by_side([left[i] for i in rows], [right[i] for i in rows], most[rows])
        at = to
    return out | ((m == n) & (m == 0))


def side_by_side(left: list[str], right: list[str], most: np.ndarray) -> np.ndarray:
    """Whether Levenshtein distances of pairs are at most ``most``, by bit-parallel rows in blocks of 64 characters, all pairs at once.

    Only blocks that touch the diagonals up to the largest of ``most`` are computed; what lies beyond counts as larger, which it is.
    Pairs that have ended, or whose distance on the diagonal to the end is too large already (it never falls there), are left out from time to time.
    """
    m, n = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    order = np.argsort(n, kind="stable")
    m, n, most = m[order], n[order], most[order]
    amount, width, blocks, far = len(m), int(n.max()), int((m.max() + 63) // 64), int(most.max()) + 1
    a, b = (np.frombuffer("".join([side[i] for i in order]).encode("utf-32-le", "replace"), np.uint32) for side in (left, right))
    codes = np.concatenate([a, b])
    numbers = np.bincount(codes) > 0
    kinds = int(numbers.sum()) + 1
    codes = (np.cumsum(numbers) - 1)[codes]
    if kinds * blocks * amount > 8_000_000 and amount > 1:  # scripts of many characters
        half, out = amount // 2, np.empty(amount, bool)
        for part in (slice(0, half), slice(half, amount)):
            out[order[part]] = side_by_side([left[i] for i in order[part]], [right[i] for i in order[part]], most[part])
        return out
    pattern, text = np.full((amount, blocks * 64), kinds - 1, np.int32), np.full((amount, width), kinds - 1, np.int32)
    pattern[np.arange(blocks * 64) < m[:, None]] = codes[: len(a)]
    text[np.arange(width) < n[:, None]] = codes[len(a) :]
    base = np.arange(amount) * kinds
    text = text.T + base
    has = np.zeros((blocks, amount * kinds), np.uint64)  # the places of each letter in each text of the left
    for w in range(blocks):
        for i in range(64):
            has[w, base + pattern[:, 64 * w + i]] |= np.uint64(1 << i)
    one, top, which = np.uint64(1), np.uint64(63), np.arange(amount)  # of the pairs that are left
    plus, minus = np.full((blocks, amount), np.uint64((1 << 64) - 1)), np.zeros((blocks, amount), np.uint64)
    score = np.repeat((np.arange(blocks, dtype=np.int64) + 1)[:, None] * 64, amount, axis=1)  # at the bottom of each block
    ends = np.searchsorted(n, np.arange(width + 2))  # pairs ended before each row
    out, last = np.zeros(amount, bool), min(blocks - 1, far // 64)

    def at_row(i: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distances of beginnings of the left texts, of so many characters, from what has been read of the right ones."""
        w, above = (row - 1) // 64, ~((np.uint64(2) << ((row - 1) % 64).astype(np.uint64)) - one)
        d = score[w, i] - np.bitwise_count(plus[w, i] & above) + np.bitwise_count(minus[w, i] & above)
        return np.where((w >= low) & (w <= last), d, far)

    for j in range(width):
        if last < (reach := min(blocks - 1, (j + far) // 64)):
            last = reach
            score[last] = score[last - 1] + 64
        low = max(0, j - far) // 64
        up, down = np.ones(len(which), np.uint64), np.zeros(len(which), np.uint64)
        for w in range(low, last + 1):
            p, q = plus[w], minus[w]
            eq = has[w].take(text[j])
            x = eq | q
            eq |= down
            h = eq & p
            h += p
            h ^= p
            h |= eq
            fall = p & h
            h |= p
            rise = np.invert(h, out=h)
            rise |= q
            up_next, down_next = rise >> top, fall >> top
            score[w] += up_next.view(np.int64)
            score[w] -= down_next.view(np.int64)
            rise <<= one
            rise |= up
            np.bitwise_and(rise, x, out=q)
            x |= rise
            fall <<= one
            fall |= down
            np.invert(x, out=p)
            p |= fall
            up, down = up_next, down_next
        if ends[j + 1] < ends[j + 2]:
            i = np.arange(ends[j + 1], ends[j + 2])
            out[which[i]] = at_row(i, m[i]) <= most[i]
        if j % 32 == 31:
            row = m - n + j + 1
            left_over = np.flatnonzero(n > j + 1)
            left_over = left_over[(row[left_over] <= 0) | (at_row(left_over, np.maximum(row[left_over], 1)) <= most[left_over])]
            if not len(left_over):
                break
            if len(left_over) < 0.8 * len(which):
                which, m, n, most = which[left_over], m[left_over], n[left_over], most[left_over]
                plus, minus, score = plus[:, left_over], minus[:, left_over], score[:, left_over]
                has = has.reshape(blocks, -1, kinds)[:, left_over].reshape(blocks, -1)
                text = text[:, left_over] - base[left_over] + base[: len(which)]
                base, ends = base[: len(which)], np.searchsorted(n, np.arange(width + 2))
    back = np.empty(amount, bool)
    back[order] = out
    return back


def binned_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """:func:`distances` of texts side by side."""
    texts, bins = binned([x.encode("utf-8", "replace") for x in [*left, *right]])
    i = np.arange(len(left))
    return distances(np.array([len(t) for t in texts], np.int64), bins, i, i + len(left))


def settled(a: str, b: str) -> bool:
    """Whether the edit similarity is high enough, for lines whose profiles allow it."""
    most = allowed(a, b)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    return 2 * len(set(x) & set(y)) >= len(x) / 2 and within(x, y, most) or edit_distance(a, b, most) <= most


def similar(a: str, b: str) -> bool:
    """Whether the edit similarity is high enough.

    An edit takes away three triples of characters at most and brings three: counts of triples rule out most lines
    that are not. An alignment by words accepts most lines that are. The edit distance settles the rest.
    """
    return not apart(profile(a), profile(b), allowed(a, b)) and settled(a, b)


def row_key() -> F.Column:
    """A number for each document: rows of one doc_id and unlike texts are told apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def lines_of(batch: pa.RecordBatch, least: int):
    """doc_id, row, line_no and normalised line, as four sequences, of the lines of documents that count, for up to 64 documents in turn."""
    ids, rows, texts = (batch.column(i).to_pylist() for i in range(3))
    for at in range(0, len(texts), 64):
        found = [(d, r, n, x) for d, r, t in zip(ids[at : at + 64], rows[at : at + 64], texts[at : at + 64], strict=True) if t for n, x in enumerate(normalise(t)) if counts(x, least)]
        if found:
            yield zip(*found, strict=True)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, row (number of the document), text of the documents with an id."""
    small_batches(docs.sparkSession)
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string"))


def surveyed_lines(docs: DataFrame, parts: int) -> DataFrame:
    """part, entries: all lines that count, dealt by line to parts below 0, as many SEENs in one value; and the keys of those that
    are compared with unequal ones, dealt by key to parts from 0 on, as ENTRYs.

    A line that a task meets again mostly gets no second keys. Lines and keys travel as arrays and not as rows, which
    would cost more than all the rest.
    """

    def run(batches):
        known: set[int] = set()  # lines whose keys this task has returned already
        held, seen, amount = [], [], 0

        def dealt():
            for all_of, below in ((held, False), (seen, True)):
                if not all_of:
                    continue
                e, part = (np.concatenate([x[i] for x in all_of]) for i in range(2))
                order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
                e, part = e[order], part[order]
                begins = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                entries = [e[x:y].tobytes() for x, y in zip(begins, [*begins[1:], len(e)], strict=True)]
                numbers = part[begins].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(-1 - numbers if below else numbers), pa.array(entries, pa.binary())], ["part", "entries"])

        for b in batches:
            for doc, row, no, lines in lines_of(b, MIN_BYTES):
                names = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
                e = np.empty(len(lines), SEEN)
                e["line"], e["doc_id"], e["row"], e["line_no"] = names.view(np.int64), doc, row, no
                seen.append((e, (names >> np.uint64(32)) % np.uint64(parts)))
                amount += len(e)
                if len(known) > 200_000:
                    known.clear()
                fresh = {}
                for h, x in zip(names.tolist(), lines, strict=True):
                    if h not in known and counts(x, FUZZY_BYTES):
                        known.add(h)
                        fresh[h] = x
                if fresh:
                    chars, keys, places, marks = placed_sketches(list(fresh.values()))
                    i, slot, k = np.nonzero(keys)
                    key = keys[i, slot, k]
                    e = np.empty(len(i), ENTRY)
                    e["key"] = key & np.uint64(0xFFFFFFFF - (1 << SLOT_BITS) + 1) | (slot * KEYS + k).astype(np.uint64)
                    e["marks"], e["line"] = marks[i, slot, k], np.fromiter(fresh, np.uint64, len(fresh)).view(np.int64)[i]
                    e["chars"], e["place"] = np.minimum(chars, ANYWHERE)[i], np.where(chars[i] < ANYWHERE, places[i, slot, k], ANYWHERE)
                    held.append((e, (key >> np.uint64(32)) % np.uint64(parts)))
                    amount += len(e)
                if amount > 1_000_000:
                    yield from dealt()
                    held, seen, amount = [], [], 0
        yield from dealt()

    return numbered(docs).mapInArrow(run, "part int, entries binary")


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lengths and places of a shared key allow the edit similarity, and marks make it likely, for ENTRYs side by side.

    Lines that are aligned at a shared n-gram need as many edits before it as it is displaced, and so do the rests.
    Lengths of more than ANYWHERE characters count as that many and lie anywhere, which rules out no pair that is similar.
    """
    a, b, p, q = (v.astype(np.int64) for v in (x["chars"], y["chars"], x["place"], y["place"]))
    most = np.maximum(a, b) // 10
    good = (np.abs(a - b) <= most) & ((p == ANYWHERE) | (q == ANYWHERE) | (np.abs(p - q) + np.abs(a - p - b + q) <= most))
    s, t = x["marks"], y["marks"]
    unlike = s ^ t
    unlike = (unlike | unlike >> np.uint32(1)) & np.uint32(0x55555555)
    return good & ((s == 0) | (t == 0) | (np.bitwise_count(unlike) <= MARKS))


def window_array() -> F.Column:
    """The two overlapping windows of length that a line lies in. Lines whose lengths :func:`fit` share one at least.

    Windows are as wide as two allowed differences of length, on a logarithmic scale, and each begins in another's middle.
    """
    scaled = F.log("chars") / F.lit(-2.002 * log(EDIT_SIMILARITY))
    return F.array(2 * F.floor(scaled), 2 * F.floor(scaled + 0.5) + 1)


def windows() -> F.Column:
    """A row for each of :func:`window_array`."""
    return F.explode(window_array()).alias("window")


def ranks(sizes: np.ndarray) -> np.ndarray:
    """The place of each member in its group, for groups one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def meetings(rank: np.ndarray, times: np.ndarray):
    """Pairs of members of groups one after the other, in portions of a million or so: each member with the first ``times`` of its group."""
    ends = np.cumsum(times)
    at = 0
    while at < len(rank):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
        right = np.repeat(np.arange(at, to), times[at:to])
        nth = ranks(times[at:to])
        yield right - rank[right] + nth, right, nth
        at = to


def survey(docs: DataFrame) -> DataFrame:
    """Lines and candidates, in one pass over the documents: kind, key, a, b, chars, place, marks, n.

    Of kind 0, :func:`candidates`. Of kind 1, the first row (by doc_id, row, line_no) with each line: key (doc_id),
    a (the line), b (row), n (line_no). Of kind 2, the others with an equal line, likewise.
    """
    amount = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    parts, most = max(8, int(amount // PART_BYTES)), SMALL_GROUP
    names = ["kind", "key", "a", "b", "chars", "place", "marks", "n"]

    def repeated(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table["entries"].to_pylist()), SEEN)
        e = e[np.lexsort((e["line_no"], e["row"], e["doc_id"], e["line"]))]
        e = e[np.r_[True, e[1:] != e[:-1]][: len(e)]]
        first = np.r_[True, e["line"][1:] != e["line"][:-1]][: len(e)]
        none = pa.nulls(len(e), pa.int32())
        return pa.table([pa.array(np.where(first, 1, 2).astype(np.int32)), e["doc_id"].copy(), e["line"].copy(), e["row"].copy(), none, none, none, e["line_no"].copy()], names)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part < 0:
            return repeated(table)
        e = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
        e = e[np.argsort(e["key"])]
        same = e["key"][1:] == e["key"][:-1]
        e = e[np.r_[False, same] | np.r_[same, False]]
        e = e[np.lexsort((e["line"], e["key"]))]
        e = e[np.r_[True, (e["key"][1:] != e["key"][:-1]) | (e["line"][1:] != e["line"][:-1])][: len(e)]]
        begins = np.flatnonzero(np.r_[True, e["key"][1:] != e["key"][:-1]][: len(e)])
        sizes = np.diff(np.r_[begins, len(e)])
        rank, n = ranks(sizes), np.repeat(sizes, sizes)
        a, b, member = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], (n > most) & (rank > 0)
        for left, right, nth in meetings(rank, np.where(n <= most, rank, np.minimum(rank, 1))):
            good = fit(e[left], e[right])
            star, rest = good & (nth == 0), good & (nth > 0)
            a.append(e["line"][left[star]])
            b.append(e["line"][right[star]])
            member[left[rest]] = member[right[rest]] = True
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        a, b = a[new], b[new]
        e, n = e[member], n[member]
        pairs, none, some = np.zeros(len(a), np.int64), np.ones(len(a), bool), np.zeros(len(e), bool)
        whole = lambda name: pa.array(np.r_[pairs, e[name]].astype(np.int32))
        cols = [
            pa.array(np.zeros(len(a) + len(e), np.int32)), pa.array(np.r_[pairs, np.int64(part) << 32 | e["key"].astype(np.int64)], pa.int64(), mask=np.r_[none, some]),
            pa.array(np.r_[a, e["line"]], pa.int64()), pa.array(np.r_[b, e["line"]], pa.int64()), whole("chars"), whole("place"),
            pa.array(np.r_[pairs, e["marks"]].astype(np.uint32).view(np.int32)), pa.array(np.r_[pairs, n].astype(np.int32)),
        ]
        return pa.table(cols, names)

    return cut(surveyed_lines(docs, parts).groupBy("part").applyInArrow(run, "kind int, key long, a long, b long, chars int, place int, marks int, n int"), "survey")


def candidates(docs: DataFrame) -> DataFrame:
    """Candidates among different lines, as a table of leads' pairs and members: key, a, b, chars, place, marks, n.

    Lines with a common key that :func:`fit` are candidates, however many have that key. Rows without a key are pairs
    of a group's lead, its smallest line, with another one (a < b). The others' pairs are not listed: rows with a key
    are members that fit another one than the lead (in groups of more than SMALL_GROUP: all but the lead): a (the
    line), n (the number of lines of the group).
    """
    return candidates_of(survey(docs))


def candidates_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 0").drop("kind")


def labels_of(edges: DataFrame) -> DataFrame:
    """line, label: the smallest line that a linked line is or has a link to. Lines of one label belong together."""
    return edges.select(F.explode(F.array("a", "b")).alias("line"), "a").groupBy("line").agg(F.min("a").alias("label"))


def members_of(found: DataFrame, edges: DataFrame) -> DataFrame:
    """line, chars, label, places (key, window, place, marks, size): the members that share a key with a line that they are not linked to.

    Groups of more than JOB_LINES lines are dealt by windows of length.
    """
    window = F.explode(F.when(F.col("n") <= JOB_LINES, F.array(F.lit(0).cast("long"))).otherwise(window_array())).alias("window")
    rows = found.where("key IS NOT NULL").select("key", F.col("a").alias("line"), "chars", "place", "marks", "n").join(labels_of(edges), "line", "left")
    rows = rows.select("key", window, "line", "chars", "place", "marks", F.coalesce("label", "line").alias("label"))
    met = Window.partitionBy("key", "window")
    rows = rows.select("*", F.min("label").over(met).alias("low"), F.max("label").over(met).alias("high"), F.count("*").over(met).cast("int").alias("size")).where("low < high")
    return rows.groupBy("line", "chars", "label").agg(F.array_sort(F.collect_list(F.struct("key", F.col("window").cast("int").alias("window"), "place", "marks", "size"))).alias("places"))


def flat(column: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, pa.StructArray]:
    """The values of a column of lists, in another order of rows: the row of each, and the values."""
    lists = column.combine_chunks().take(pa.array(order))
    return np.repeat(np.arange(len(order)), pc.list_value_length(lists).to_numpy()), lists.flatten()


def remaining_pairs(found: DataFrame, edges: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """Candidates (a, b) other than the leads' own whose lines ``edges`` does not link; with ``payloads``, links among these.

    With ``payloads`` the lines' texts travel to the groups, once for each key that they share, and pairs are compared
    there, none whose lines the links found there join already. So no row is a pair that is not similar, and what
    travels grows with the lines and not with the pairs. A pair that shares several keys is compared in the group of
    the first of these that it fits: members know their lower keys.
    """
    compare = payloads is not None
    members = cut(members_of(found, edges), "open-members")
    rows = members.withColumn("payload", F.lit(None).cast("binary")) if not compare else members.join(payloads, members["line"] == payloads["id"]).drop("id")
    size = F.aggregate("places", F.lit(0).cast("long"), lambda s, x: s + F.least(x["size"], F.lit(JOB_LINES)))
    amount, pairs = members.agg(F.sum(F.size("places") * (F.col("chars") + 60)), F.sum(size) / 2).first()
    jobs = max(8, int((amount or 0) // JOB_BYTES), int((pairs or 0) // JOB_PAIRS))
    earlier = F.transform(F.slice("places", 1, F.col("pos")), lambda x: F.struct(x["key"].alias("key"), x["place"].alias("place"), x["marks"].alias("marks"))).alias("earlier")
    rows = rows.select("line", "chars", "label", "payload", "places", F.posexplode("places").alias("pos", "at")).select("line", "chars", "label", "payload", "at.*", earlier)
    rows = rows.withColumn("parts", F.ceil(F.col("size") / JOB_LINES).cast("int")).withColumn("own", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    rows = rows.select("key", "window", window_array()[0].alias("even"), "place", "marks", "x", "y", "own", "line", "chars", "label", "payload", "earlier").withColumn("job", F.pmod(F.xxhash64("key", "window", "x", "y"), F.lit(jobs)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        return meet(table, compare)

    with heavy(found.sparkSession, 500):
        out = rows.groupBy("job").applyInArrow(run, "a long, b long")
        out = cut(out, "more-line-links")
    drop_table(members)
    return out


def meet(table: pa.Table, compare: bool) -> pa.Table:
    """The pairs (a, b) of one task's members of groups, each in the first of its groups that it fits; if ``compare``, links among them."""
    table = table.combine_chunks()
    cols = {c: table[c].to_numpy().astype(np.int64) for c in ("key", "window", "x", "y", "own", "line", "chars", "place", "marks", "label", "even")}
    order = np.lexsort([cols[c] for c in ("line", "y", "x", "window", "key")])
    key, window, x, y, own, line, chars, place, marks, label, even = (c[order] for c in cols.values())
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in (key, window, x, y)], axis=0)]
    sizes = np.diff(np.r_[np.flatnonzero(new), len(key)])
    group, rank = np.cumsum(new) - 1, ranks(sizes)
    names, some, slot = np.unique(line, return_index=True, return_inverse=True)
    e = np.empty(len(key), [("chars", np.int64), ("place", np.int64), ("marks", np.uint32)])
    e["chars"], e["place"], e["marks"] = chars, place, marks.astype(np.uint32)
    # lower keys of each line, a column for each slot
    row, values = flat(table["earlier"], order)
    lower, lower_place, lower_marks = (values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "place", "marks"))
    of = slot[row]
    used, column = np.unique(lower & (1 << SLOT_BITS) - 1, return_inverse=True)
    shape = (len(used), len(names))
    keys, known = np.full(shape, -1), np.zeros(shape, e.dtype)
    keys[column, of] = lower
    known["chars"] = chars[some]
    known["place"][column, of], known["marks"][column, of] = lower_place, lower_marks.astype(np.uint32)

    def first(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pairs meet in no earlier group."""
        out = (window[left] == even[left]) | (window[left] == 0) | (even[left] != even[right])
        for mine, facts in zip(keys, known, strict=True):
            rest = np.flatnonzero(out)
            i, j = slot[left[rest]], slot[right[rest]]
            both = mine[i]
            same = (both == mine[j]) & (both >= 0) & (both < key[left[rest]])
            rest, i, j = rest[same], i[same], j[same]
            out[rest[fit(facts[i], facts[j])]] = False
        return out

    pairs = [np.zeros((2, 0), np.int64)]
    for left, right, _ in meetings(rank, rank):
        good = (label[left] != label[right]) & ((x[left] == y[left]) | (own[left] != own[right]))
        left, right = left[good], right[good]
        good = fit(e[left], e[right])
        left, right = left[good], right[good]
        good = first(left, right)
        pairs.append(np.stack([left[good], right[good]]))
    pairs = np.concatenate(pairs, axis=1)
    if compare:
        pairs = joining(pairs, group, slot, label, table["payload"].take(pa.array(order[some])).to_pylist())
    ends = np.unique(np.sort(line[pairs], axis=0), axis=1)
    return pa.table([ends[0], ends[1]], ["a", "b"])


def joining(pairs: np.ndarray, group: np.ndarray, slot: np.ndarray, label: np.ndarray, payloads: list[bytes]) -> np.ndarray:
    """Those of the pairs of members that are similar and join labels of their group that others of them don't join.

    ``slot`` has the number of each member's text. The nearest are compared first, as those that are joined by others need no comparison.
    """
    texts, bins = binned(payloads)
    left, right = pairs
    far = distances(np.array([len(t) for t in texts], np.int64), bins, slot[left], slot[right])
    order = np.argsort(far, kind="stable")[: int((far <= 1).sum())]
    left, right = left[order], right[order]
    node = np.unique(np.stack([group, label]), axis=1, return_inverse=True)[1].ravel()
    joined, found, at, step = np.arange(len(group)), [], 0, 2048
    while at < len(left):
        part = np.arange(at, min(at + step, len(left)))
        at, step = at + step, min(2 * step, 16384)
        part = part[joined[node[left[part]]] != joined[node[right[part]]]]
        good = near([texts[i] for i in slot[left[part]]], [texts[i] for i in slot[right[part]]])
        for i, j in zip(left[part[good]].tolist(), right[part[good]].tolist(), strict=True):
            u, v = joined[node[i]], joined[node[j]]
            if u != v:
                joined[joined == u] = v
                found.append((i, j))
    return np.array(found, np.int64).reshape(-1, 2).T


def leading_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups' leads and other lines."""
    return found.where("key IS NULL").select("a", "b").distinct()


def payloads_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, payload: the normalised bytes of lines (line, first), taken from the first document that has each (rarely twice, if that is there twice)."""
    wanted = classes.select(F.col("line").alias("id"), F.col("first.row").alias("_row"), F.col("first.line_no").alias("line_no"))
    wanted = wanted.groupBy("_row").agg(F.collect_list(F.struct("line_no", "id")).alias("wanted"))  # lines of one document
    texts = docs.where("doc_id IS NOT NULL").select(row_key().alias("row"), F.col("text").cast("string").alias("text"))
    texts = texts.join(wanted.hint("shuffle_hash"), texts["row"] == wanted["_row"]).select("text", "wanted.line_no", "wanted.id", "row")

    def pick(batches):
        done: set[int] = set()  # equal rows mostly are one task's
        for b in batches:
            ids, payloads = [], []
            for text, places, group, row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if row in done:
                    continue
                done.add(row)
                parts = text.split("\n")
                ids += group
                payloads += [normalise(parts[n])[0] for n in places]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], ["id", "payload"])

    return texts.mapInArrow(pick, "id long, payload binary")


def pair_edges(pairs: DataFrame, payloads: DataFrame, name: str) -> DataFrame:
    """Those of the pairs (a, b) that are similar, as a table."""

    def run(batches):
        for b in batches:
            left, right = ([x.decode("utf-8", "replace") for x in b.column(i).to_pylist()] for i in (2, 3))
            bins = binned_pairs(left, right)
            good = bins <= 1
            good[good] = [settled(left[i], right[i]) if far <= ALIGNED else True for i, far in zip(np.flatnonzero(good), bins[good], strict=True)]
            rest = np.flatnonzero(good & (bins > ALIGNED))
            good[rest] = near([left[i] for i in rest], [right[i] for i in rest])
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(payloads.select(F.col("id").alias("a"), F.col("payload").alias("x")), "a")
    both = left.join(payloads.select(F.col("id").alias("b"), F.col("payload").alias("y")), "b").select("a", "b", "x", "y")
    with heavy(pairs.sparkSession, 3000):
        return cut(both.mapInArrow(run, "a long, b long"), name)


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """Lines that repeat an earlier one of their group: doc_id, row (:func:`row_key` of the document), lines (numbers from 0, ascending).

    Lines are normalised; equal ones of at least MIN_BYTES bytes or MIN_WORDS words are one class. Classes of at least
    FUZZY_BYTES bytes or MIN_WORDS words that share a key of their sketches of n-grams are candidates, whose edit
    similarity is verified; linked classes are one group. A group keeps its first line, by doc_id and number.

    Rows of one doc_id are told apart by their texts (and ordered by a hash of these); rows that are equal in both
    count as one document. Null doc_id or text, empty text: no lines. Very long lines: compared whole. Ties (equal
    lines): the first stays. Empty table: no rows. Other columns are ignored.
    """
    with settings(docs.sparkSession, spark__sql__objectHashAggregate__sortBased__fallbackThreshold=str(GROUPS)):
        return gone_lines(docs, survey(docs))


def gone_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """:func:`duplicate_lines` of documents, from their :func:`survey`."""
    seen = [found.where(F.col("kind") == k).select(F.col("a").alias("line"), F.struct(F.col("key").alias("doc_id"), F.col("b").alias("row"), F.col("n").alias("line_no")).alias("first")) for k in (1, 2)]
    open_lines = candidates_of(found)
    ids = open_lines.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    classes = cut(seen[0].join(ids, seen[0]["line"] == ids["id"], "left_semi"), "line-classes")
    payloads = cut(payloads_of(docs, classes), "line-texts")
    edges = pair_edges(leading_pairs(open_lines), payloads, "line-links")
    linked = cut(components(edges).select(F.col("component").alias("a"), F.col("id").alias("b")), "lead-groups")
    more = remaining_pairs(open_lines, linked, payloads)
    for t in (payloads, edges):
        drop_table(t)
    groups = cut(components(linked.unionByName(more)), "line-groups")
    drop_table(linked)
    grouped = cut(classes.join(groups, classes["line"] == groups["id"]).select("component", "first"), "linked-lines")
    firsts = grouped.groupBy("component").agg(F.min("first").alias("keep"))
    later = grouped.join(firsts, "component").where(F.col("first") > F.col("keep")).select("first.*")
    gone = later.unionByName(seen[1].select("first.*"))  # the first of a line that others precede, and all that have an equal one before them
    out = cut(gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("line_no")).alias("lines")), "gone-lines")  # lines of one document
    for t in (found, classes, more, groups, grouped):
        drop_table(t)
    return out


def drop_duplicate_lines(docs: DataFrame, keep_whole: bool = False) -> DataFrame:
    """``docs`` without repeated lines (see :func:`duplicate_lines`), with lines_removed; other columns stay.

    A document keeps its other lines in order, joined as before. One that would lose every line with a word keeps an
    empty text; with ``keep_whole`` it stays as it is instead, for document deduplication to judge as a whole.
    ``n_chars``, if there is such a column, becomes the new length. Null text stays null. A column lines_removed of
    the input is replaced. Rows without doc_id keep all lines.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lines_removed")
    gone = duplicate_lines(docs).select(F.col("row").alias("_row"), F.col("lines").alias("_lines"))
    joined = docs.join(gone.hint("shuffle_hash"), row_key() == gone["_row"], "left").drop("_row")
    names, place = docs.columns, docs.columns.index("text")
    size, known = (names.index(c) if c in names else None for c in ("n_chars", "doc_id"))

    def run(batches):
        for b in batches:
            cols, counts = [*b.columns[:-1]], np.zeros(b.num_rows, np.int32)
            hit = pc.and_(pc.and_(pc.is_valid(b.columns[-1]), pc.is_valid(b.column(place))), pc.is_valid(b.column(known)))
            rows = np.flatnonzero(hit.to_numpy(zero_copy_only=False))
            if len(rows):
                texts = []
                for i, text, drop in zip(rows, b.column(place).filter(hit).cast(pa.string()).to_pylist(), b.columns[-1].filter(hit).to_pylist(), strict=True):
                    out = set(drop)
                    left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in out)
                    whole = keep_whole and not left.strip()
                    texts.append(text if whole else left)
                    counts[i] = 0 if whole else len(out)
                cols[place] = pc.replace_with_mask(cols[place], hit, pa.array(texts, cols[place].type))
                if size is not None:
                    cols[size] = pc.replace_with_mask(cols[size], hit, pa.array([len(t) for t in texts], cols[size].type))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts)], [*names, "lines_removed"])

    return joined.mapInArrow(run, StructType([*docs.schema.fields, StructField("lines_removed", IntegerType())]))
