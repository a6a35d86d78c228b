"""Words of whole texts (runs of bytes other than ASCII white space), batch by batch, as arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


@dataclass
class Words:
    """Words of several texts one after another."""

    starts: np.ndarray  # place of each text's first word, and the number of all words
    ids: np.ndarray  # each word's place in ``distinct``
    distinct: pa.Array
    flat: pa.Array  # the words themselves

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; each distinct one is hashed once."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(self.distinct))
        return own[self.ids] if len(own) else np.zeros(0, np.uint64)

    def owners(self) -> np.ndarray:
        """The number of the text that each word is from."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Each text's kept words, joined by one space."""
        ends = np.concatenate([[0], np.cumsum(kept)])[self.starts]
        flat = self.flat if kept.all() else self.flat.filter(pa.array(kept))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), " ")


def words_of(texts: pa.Array) -> Words:
    """Words of texts; a null text has none."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    starts = np.concatenate([[0], np.cumsum(full)])[offsets]
    flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Words(starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, flat)


def portions(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in portions of at most ``most`` bytes of text each (a longer text is a portion alone)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += n
    if first < batch.num_rows:
        yield batch.slice(first)
