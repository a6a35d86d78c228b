"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, connected groups."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.blocks import candidate_blocks, forest, shared_keys, verified_edges
from sori.llm.graph import components
from sori.llm.store import cut, drop_table, small_batches

WORDS = 5
#: Bands and rows of a signature. A pair at similarity 0.85 shares two bands with probability 0.99995, at 0.80 with 0.994.
BANDS, ROWS = 40, 8
GOLD = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of five words (the whole sequence if it has fewer)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix((h + GOLD) * GOLD ^ a[k : n - width + 1 + k])
    return np.unique(h)


def superminhash(values: np.ndarray, owner: np.ndarray, docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures (docs x m) of the element hashes ``values``; ``owner`` is each element's document, ascending.

    Element e puts, in step j, the value j + r at place p of a random permutation of its own; a place keeps the
    smallest value. All elements of the batch take step j together. A document stops when all its places are taken,
    as later steps bring only larger values. The permutations are drawn step by step: the first steps look values up
    among the few swaps made, later ones (short documents only) hold the permutations of those that go on.
    """
    sig = np.full(docs * m, EMPTY, np.uint64)
    h, doc = values, owner
    swaps: list[tuple[np.ndarray, np.ndarray]] = []
    perm = None
    for j in range(m):
        r = mix(h + np.uint64((j + 1) * int(GOLD) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if perm is None:
            place, moved = k.copy(), np.full(len(k), j, np.int64)
            for at, value in swaps:
                place = np.where(at == k, value, place)
                moved = np.where(at == j, value, moved)
            swaps.append((k, moved))
        else:
            row = np.arange(len(k))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(sig, doc * m + place, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
        going = (sig.reshape(docs, m) == EMPTY).any(axis=1)[doc]
        if not going.all():
            h, doc = h[going], doc[going]
            swaps = [(a[going], b[going]) for a, b in swaps]
            perm = None if perm is None else perm[going]
        if not len(h):
            break
        if perm is None and j == 5:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(h), m)).copy()
            row = np.arange(len(h))
            for at, value in swaps:
                perm[row, at] = value
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix((key + GOLD) * GOLD ^ parts[:, :, r])
    return key.view(np.int64)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set; null if it is empty), keys (one for each band)."""
    small_batches(docs.sparkSession)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                sets = [shingles(t, hashes) for t in texts[i : i + 64]]
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                keys: list = [None] * len(sets)
                if len(some):
                    owner = np.repeat(np.arange(len(some)), sizes[some])
                    for k, line in zip(some, band_keys(superminhash(np.concatenate([sets[k] for k in some]), owner, len(some), BANDS * ROWS)), strict=True):
                        keys[k] = line
                ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(sets)), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "keys"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id, payload: the set of each document, as bytes."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, hashes).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "payload"])

    return docs.select("id", "text").mapInArrow(run, "id long, payload binary")


def similar(ids: list[int], payloads: list[bytes], split: int, percent: int) -> list[tuple[int, int]]:
    """Spanning links of documents with 100 * intersection >= percent * union, by counting over posting lists."""
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    values, which = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(which, kind="stable")
    posting, start = owner[order], np.searchsorted(which[order], np.arange(len(values) + 1))
    first = np.cumsum(size) - size

    def partners(k: int, group: np.ndarray) -> np.ndarray:
        if split and k >= split:
            return np.zeros(0, np.int64)
        mine = which[first[k] : first[k] + size[k]]
        n = start[mine + 1] - start[mine]
        at = np.repeat(start[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))
        good = 100 * both >= percent * (size[k] + size - both)
        good[: max(k + 1, split)] = False
        good &= group != group[k]
        return np.flatnonzero(good)

    return forest(ids, partners)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of documents linked by a similarity of at least ``percent`` / 100: doc_id, n_shingles, component_id, kept.

    Similarity is the Jaccard coefficient of the sets of distinct shingles of five words (lower case for A-Z, split at
    ASCII white space). Equal sets are one class from the start. Classes get SuperMinHash signatures; those that share
    two bands are candidates, and candidates are compared on their full sets (64-bit hashes of shingles), block by
    block. ``component_id`` is the smallest doc_id that links reach, ``kept`` marks it.

    Null or empty text and text without words: an empty set, linked with nothing. Fewer than five words: one shingle.
    Null doc_id: takes no part, component_id null, kept true. Repeated rows and rows that share a doc_id count as one
    document, each row is returned. Empty table: no rows. Other columns are ignored.
    """
    rows = cut(features(docs), "features")
    named = rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys")), "classes")
    shared = shared_keys(classes.select(F.explode("keys").alias("key"), "id"))
    members, block_pairs = candidate_blocks(shared, classes.select("id", "size").distinct(), 2)
    drop_table(shared)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(members.select("id").distinct(), "id", "left_semi")
    edges = verified_edges(members, block_pairs, shingle_sets(texts).dropDuplicates(["id", "payload"]), partial(similar, percent=percent))
    groups = cut(components(edges), "components")
    firsts = cut(classes.select("set_id", "id").join(groups, "id", "left").select("set_id", F.coalesce("component", "id").alias("component_id")), "firsts")
    out = rows.select("doc_id", "n_shingles", "set_id").join(firsts, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without those that :func:`near_duplicates` does not keep; all columns stay as they are."""
    gone = cut(near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
