"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sori.llm.store import small_batches
from sori.llm.tokens import CACHE_WORDS, LATIN_WORDS, byte_alphabet

NONE = 1 << 60
#: A leaf's value is its pair's rank, then its place: the smallest value is the leftmost pair of the lowest rank.
PLACE_BITS = 32
#: Words of up to so many bytes are merged many at a time, longer ones singly.
SHORT = 64


class SegmentTreeBPE:
    """Byte-level BPE from a tokenizer file (vocabulary, merges and added tokens; nothing is trained)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        self.width = max(vocab.values()) + 2
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.rank_of = dict(zip(key.tolist(), range(len(merges)), strict=True))
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.back = back
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.words: dict[str, bytes] = {}

    def values(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of the pairs (left, right) at the given places; NONE where there is no such merge."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), (self.ranks[at] << PLACE_BITS) | place, NONE)

    def merge_many(self, words: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of words of at most ``size`` (a power of two) bytes; one tree for each word, all advanced together."""
        n = len(words)
        ids = np.full((n, size), -1, dtype=np.int64)
        for i, w in enumerate(words):
            ids[i, : len(w)] = self.byte_id[np.frombuffer(w, dtype=np.uint8)]
        place = np.arange(size)
        after = np.broadcast_to(place + 1, (n, size)).copy()
        before = np.broadcast_to(place - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        tree[:, size : 2 * size - 1] = self.values(ids[:, :-1], ids[:, 1:], place[:-1])
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            at, rank = root & ((1 << PLACE_BITS) - 1), root >> PLACE_BITS
            gone = after[row, at]
            far = after[row, gone]
            ids[row, at] = self.merged[rank]
            ids[row, gone] = -1
            after[row, at] = far
            inside = far < size
            before[row[inside], far[inside]] = at[inside]
            prev = before[row, at]
            right = np.where(inside, ids[row, np.minimum(far, size - 1)], -1)
            left = np.where(prev >= 0, ids[row, np.maximum(prev, 0)], -1)
            mine = ids[row, at]
            self._put(tree, row, gone + size, np.full(len(row), NONE))
            self._put(tree, row, at + size, self.values(mine, right, at))
            has = prev >= 0
            self._put(tree, row[has], prev[has] + size, self.values(left[has], mine[has], prev[has]))
            row = row[tree[row, 1] < NONE]
        return [r[r >= 0] for r in ids]

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        tree[row, leaf] = value
        node = leaf >> 1
        for _ in range(tree.shape[1].bit_length() - 2):
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            node >>= 1

    def merge_one(self, word: bytes) -> list[int]:
        """The same over one long word, with plain lists."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        size = 1 << max(1, (n - 1).bit_length())
        width, rank_of, merged = self.width, self.rank_of, self.merged
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank_of.get(ids[i] * width + ids[i + 1])
            if r is not None:
                tree[size + i] = (r << PLACE_BITS) | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << PLACE_BITS) - 1

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    break
                tree[k] = best
                k >>= 1

        def pair(i: int, j: int) -> int:
            r = rank_of.get(ids[i] * width + ids[j])
            return NONE if r is None else (r << PLACE_BITS) | i

        while tree[1] < NONE:
            at = tree[1] & mask
            ids[at] = int(merged[tree[1] >> PLACE_BITS])
            gone = after[at]
            far = after[gone]
            ids[gone], after[at] = -1, far
            put(gone, NONE)
            if far < n:
                before[far] = at
            put(at, pair(at, far) if far < n else NONE)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return [i for i in ids if i >= 0]

    def learn(self, words: list[str]) -> None:
        """Put words, as strings of the byte alphabet under their own spelling, into the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            if len(raw) == 1:
                self.words[w] = np.array([self.byte_id[raw[0]]], dtype="<u4").tobytes()
            elif len(raw) > SHORT:
                self.words[w] = np.array(self.merge_one(raw), dtype="<u4").tobytes()
            else:
                by_size.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for size, group in by_size.items():
            step = max(1, (1 << 20) // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (w, _), ids in zip(part, self.merge_many([r for _, r in part], size), strict=True):
                    self.words[w] = ids.astype("<u4").tobytes()

    def split(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        try:
            text.encode("latin-1")
            return LATIN_WORDS.findall(text)
        except UnicodeEncodeError:
            back = self.back
            return [bytes(back[c] for c in w).decode() for w, _ in self.pre.pre_tokenize_str(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit bytes."""
        parts: list[list[str]] = []
        for text in texts:
            text = text or ""
            if self.split_added and self.split_added.search(text):
                words = []
                for x in self.split_added.split(text):
                    if x in self.added:
                        self.words[x] = np.array([self.added[x]], dtype="<u4").tobytes()
                        words.append(x)
                    elif x:
                        words += self.split(x)
                parts.append(words)
            else:
                parts.append(self.split(text))
        missing = [w for w in set().union(*parts) if w not in self.words] if parts else []
        if len(self.words) + len(missing) > CACHE_WORDS and len(self.words) > len(missing):
            self.words = {a: np.array([i], dtype="<u4").tobytes() for a, i in self.added.items()}
            missing = [w for w in set().union(*parts) if w not in self.words]
        self.learn(missing)
        get = self.words.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, as the library has it."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(path)


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode every whole text and decode the ids again: doc_id, ids (array of int), decoded.

    A text is split into words as the tokenizer file says; each word has a segment tree whose leaves are the ranks of
    its adjacent pairs. The root yields the leftmost pair of lowest rank; merging it updates at most three leaves and
    the nodes above them. Distinct words are merged once for each worker's cache, which is bounded.

    Null or empty text: no ids, empty decoded text. Null doc_id and repeated rows: kept. Empty table: no rows. Other
    columns are ignored. A word of any length is merged whole. An added token in a text becomes its own id.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        model = bpe(tokenizer_path)
        for b in batches:
            docs_, texts = b.column(0), b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                ids = [np.frombuffer(x, dtype="<u4") for x in model.encode(texts[i : i + 256])]
                flat = np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int32)
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                decoded = [model.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([docs_.slice(i, len(ids)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of ids and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
