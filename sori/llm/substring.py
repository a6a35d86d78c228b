"""Passages that repeat anywhere in a corpus: suffixes split by prefixes of variable length, a suffix tree for each group.

A suffix is what starts at a word with at least ``window`` words left in its text. Two suffixes belong to one repeat if
they agree in their first ``window`` words, that is, meet in a node of the suffix tree at least so deep.

Groups. A suffix's prefix ends where the smallest (by hash) n-gram of ``ANCHOR`` words within its first ``window`` words
ends: 8 to 35 words by default, as the text has it. Suffixes that agree so deep have the same prefix. Prefixes with one
last n-gram form a group, as they lie together in the text: neighbouring suffixes share a chunk of text that travels
once. Groups of one chunk hold no repeat and end there, before any text moves. Groups of up to ``GROUP`` chunks get a
suffix tree, as sorted suffixes and the common prefixes of neighbours, whose intervals are the tree's nodes. Larger
groups are split on: equal chunks become one leaf with a number first, then the suffixes of different chunks are
prefixed by their whole window, so that every such prefix is itself a node of the depth asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.minhash import mix
from sori.llm.store import cut, drop_table, settings
from sori.llm.suffixes import common_prefixes, sorted_suffixes
from sori.llm.words import Words, portions, words_of

WINDOW = 35
#: Words of the n-gram with which a suffix's prefix ends.
ANCHOR = 8
#: Chunks (of fewer than two windows of text) that a group may hold to be searched as a tree.
GROUP = 256
#: Bytes of text whose words are hashed together.
PORTION = 4 << 20
#: Odd multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """64-bit hashes of any stretches of a sequence, in constant time each."""

    def __init__(self, values: np.ndarray, base: int):
        powers = np.full(len(values), base, np.uint64)
        inverse = np.full(len(values) + 1, pow(base, -1, 1 << 64), np.uint64)
        powers[:1] = inverse[:1] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(powers), dtype=np.uint64)])
        self.back = np.cumprod(inverse)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` values."""
        if len(self.sums) <= size:
            return np.zeros(0, np.uint64)
        return mix((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size] + np.uint64(size))


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of each ``width`` values in a row, the first of equal ones."""
    place, done = np.arange(len(values)), 1
    while done < width:
        step = min(done, width - done)
        later = values[step:] < values[:-step]
        values = np.where(later, values[step:], values[:-step])
        place = np.where(later, place[step:], place[:-step])
        done += step
    return place


def chunks(words: Words, window: int) -> dict[str, np.ndarray]:
    """Suffixes of all texts, neighbours of one anchor in one chunk: text (its number), key, chunk (a hash of its words), first and last suffix."""
    owners, none = words.owners(), np.zeros(0, np.int64)
    if len(owners) < window:
        return {"text": none, "key": none.view(np.uint64), "chunk": none.view(np.uint64), "first": none, "last": none}
    anchor = min(ANCHOR, window)
    rolling = Rolling(words.hashes(), BASES[0])
    grams = rolling.all(anchor)
    place = first_smallest(grams, window - anchor + 1)
    at = np.flatnonzero(owners[: len(place)] == owners[window - 1 :])
    place = place[at]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(at) else none
    first, last, place = at[new], at[np.append(new[1:], len(at)) - 1] if len(at) else none, place[new]
    text = owners[first]
    whole = mix(rolling(first, last + window) ^ (place - first).astype(np.uint64))
    return {"text": text, "key": grams[place], "chunk": whole, "first": first - words.starts[text], "last": last - words.starts[text]}


def _anchored(rows: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in portions(batch, 1, PORTION):
                found = chunks(words_of(b.column(1)), window)
                row = b.column(0).take(pa.array(found["text"]))
                arrays = [row, *(pa.array(found[c].view(np.int64)) for c in ("key", "chunk")), *(pa.array(found[c].astype(np.int32)) for c in ("first", "last"))]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "chunk", "first", "last"])

    return rows.select("row", "text").mapInArrow(run, "row long, key long, chunk long, first int, last int")


def _suffixes(texts: DataFrame, window: int) -> DataFrame:
    """Chunks of text for the trees, and the suffixes of larger groups by two hashes of their window.

    ``texts`` has row, text, wanted: array of (key, first, last, large).
    """

    def run(batches):
        for batch in batches:
            for b in portions(batch, 1, PORTION):
                words, lists = words_of(b.column(1)), b.column(2)
                wanted = lists.flatten()
                key, first, last, large = (wanted.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                text = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                rows = b.column(0).to_numpy()
                small = np.flatnonzero(~large)
                size = last[small].astype(np.int64) - first[small] + window
                ends = np.concatenate([[0], np.cumsum(size)])
                at = np.repeat(words.starts[text[small]] + first[small] - ends[:-1], size) + np.arange(ends[-1])
                passages = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.flat.take(pa.array(at))), " ")
                none = pa.nulls(len(small), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key[small]), none, pa.array(rows[text[small]]), pa.array(first[small]), passages], NAMES)
                large = np.flatnonzero(large)
                if len(large):
                    size = last[large].astype(np.int64) - first[large] + 1
                    ends = np.concatenate([[0], np.cumsum(size)])
                    at = np.repeat(first[large] - ends[:-1], size) + np.arange(ends[-1])
                    own = np.repeat(text[large], size)
                    place, values = words.starts[own] + at, words.hashes()
                    one, two = (Rolling(v, base)(place, place + window).view(np.int64) for v, base in zip((values, mix(values)), BASES, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(rows[own]), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.string())], NAMES)

    return texts.select("row", "text", "wanted").mapInArrow(run, "key long, key2 long, row long, first int, passage string")


NAMES = ["key", "key2", "row", "first", "passage"]


def deep_leaves(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts, in order, of the suffixes that lie below a node of the suffix tree that is at least ``depth`` deep."""
    order, levels = sorted_suffixes(symbols, depth)
    deep = np.append(common_prefixes(order, levels) >= depth, False)
    return np.sort(order[deep[:-1] | deep[1:]])


def _trees(groups: DataFrame, window: int) -> DataFrame:
    """Repeated stretches (row, start, end) of the groups' chunks; ``groups`` has one array ``leaves`` of (row, first, passage)."""

    def run(batches):
        for b in batches:
            lists = b.column(0)
            leaves = lists.flatten()
            row, first = (leaves.field(i).to_numpy() for i in (0, 1))
            words = words_of(leaves.field(2))
            group = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            own = words.owners()
            place = np.arange(len(own)) + own  # behind each chunk there is a symbol of its own
            symbols = np.empty(len(own) + len(row), np.int64)
            symbols[place] = group[own] * len(words.distinct) + words.ids
            symbols[words.starts[1:] + np.arange(len(row))] = -1 - np.arange(len(row))
            owner = np.empty(len(symbols), np.int64)
            owner[place] = own
            at = deep_leaves(symbols, window) if len(symbols) else np.zeros(0, np.int64)
            edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])) if len(at) else at
            begin, end = at[edge], at[np.append(edge[1:], len(at)) - 1] if len(at) else at
            chunk = owner[begin]
            shift = first[chunk] - words.starts[:-1][chunk] - chunk
            yield pa.RecordBatch.from_arrays([pa.array(row[chunk]), pa.array((begin + shift).astype(np.int32)), pa.array((end + shift + window).astype(np.int32))], ["row", "start", "end"])

    return groups.mapInArrow(run, "row long, start int, end int")


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stretches of words (row, start, end) made of windows that start anywhere else too; they may overlap.

    ``rows`` has row (unique) and text. Every table below is written to the shared folder before it is used.
    """
    spark = rows.sparkSession
    small = {"spark__sql__execution__arrow__maxRecordsPerBatch": "1000"}
    with settings(spark, **small):
        anchored = cut(_anchored(rows, window), "anchors")
    counts = cut(anchored.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "anchor-counts")
    shared = cut(anchored.join(counts, "key"), "shared-anchors")
    drop_table(anchored)
    drop_table(counts)
    large = shared.where(F.col("n") > GROUP)
    leaves = cut(large.groupBy("key", "chunk").agg(F.count("*").alias("m"), F.min(F.struct("row", "first", "last")).alias("one")), "leaves")
    whole = cut(large.join(leaves.where("m > 1").select("key", "chunk"), ["key", "chunk"]).select("row", F.col("first").alias("start"), (F.col("last") + window).cast("int").alias("end")), "equal-chunks")
    wanted = shared.where(F.col("n") <= GROUP).select("row", "key", "first", "last", F.lit(False).alias("large"))
    wanted = wanted.unionByName(leaves.select("one.row", "key", "one.first", "one.last", F.lit(True).alias("large")))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "first", "last", "large")).alias("wanted"))  # bounded by the text's words
    with settings(spark, **small):
        suffixes = cut(_suffixes(rows.join(wanted, "row"), window), "suffixes")
    drop_table(shared)
    drop_table(leaves)
    groups = suffixes.where("key2 IS NULL").groupBy("key").agg(F.collect_list(F.struct("row", "first", "passage")).alias("leaves"))  # bounded by GROUP
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="512"):
        trees = cut(_trees(groups.select("leaves"), window), "repeats")
    windows = suffixes.where("key2 IS NOT NULL")
    often = cut(windows.groupBy("key", "key2").agg(F.count("*").alias("n")).where("n > 1").select("key", "key2"), "deep-prefixes")
    split = cut(windows.join(often, ["key", "key2"]).select("row", F.col("first").alias("start"), (F.col("first") + window).cast("int").alias("end")), "split-repeats")
    drop_table(suffixes)
    drop_table(often)
    return trees.unionByName(whole).unionByName(split)


def drop_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Texts without the words of any window that starts anywhere else in the corpus too, its own text included.

    Returns doc_id, n_words, n_removed, spans (array of start and end in words, in order, not overlapping: what was
    removed), text (the kept words, joined by one space). All occurrences go, not all but one; windows are judged on the
    input. Words are compared byte by byte within groups of up to GROUP chunks, in larger ones by 128-bit hashes.

    Null, empty or blank text: no words. Texts of fewer than ``window`` words stay. Null doc_id: kept. Repeated rows:
    all their windows repeat. Empty table: no rows. Other columns are ignored. A very long text is worked on whole, some
    200 bytes of memory a word.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    rows = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row")), "substring-rows")
    spans = repeated_spans(rows, window)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # bounded by the text's words

    def run(batches):
        for batch in batches:
            for b in portions(batch, 1, PORTION):
                yield _kept(b)

    out = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
    return rows.join(by_row, "row", "left").select("doc_id", "text", "found").mapInArrow(run, out)


def _kept(b: pa.RecordBatch) -> pa.RecordBatch:
    words, lists = words_of(b.column(1)), b.column(2)
    found = lists.flatten()
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    base = np.repeat(words.starts[:-1], sizes)
    covered = np.zeros(len(words.ids) + 1, np.int64)
    np.add.at(covered, base + found.field(0).to_numpy(zero_copy_only=False), 1)
    np.add.at(covered, base + found.field(1).to_numpy(zero_copy_only=False), -1)
    kept = np.cumsum(covered)[:-1] == 0
    own = words.owners()
    removed = np.bincount(own[~kept], minlength=b.num_rows)
    gone = np.flatnonzero(~kept)
    edge = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (own[gone[1:]] != own[gone[:-1]])])) if len(gone) else gone
    start, end = gone[edge], gone[np.append(edge[1:], len(gone)) - 1] + 1 if len(gone) else gone
    text = own[start]
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b.num_rows))])
    spans = pa.StructArray.from_arrays([pa.array(start - words.starts[text]), pa.array(end - words.starts[text])], ["start", "end"])
    arrays = [b.column(0), pa.array(np.diff(words.starts), pa.int64()), pa.array(removed, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), words.joined(kept)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "spans", "text"])
