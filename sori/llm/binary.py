"""Token-id files: independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds, in this order: one zstandard frame for each piece of a document (little-endian unsigned 32-bit ids), a
skippable frame with the index of documents, and a skippable frame with the seek table in the public seekable format
(per frame: compressed size, plain size, low half of the XXH64 of the plain bytes). A reader takes the two tables from
the end and then fetches and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.store import cut, new_path, small_batches, with_base
from sori.llm.tokens import encoder

#: Fixed values of the seekable format: magic numbers of skippable frames and of the footer, flag for checksums.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Plain bytes in one frame at most; longer documents take several frames.
FRAME_BYTES = 4 << 20
NULL_ID = -(1 << 63)


class Writer:
    """Appends documents to an open binary stream."""

    def __init__(self, out):
        self.out, self.seek, self.index = out, [], []
        self.press = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frames = 0
        for i in range(0, max(1, len(ids)), FRAME_BYTES):
            plain = ids[i : i + FRAME_BYTES]
            packed = self.press.compress(plain)
            self.out.write(packed)
            self.seek.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            frames += 1
        self.index.append((NULL_ID if doc_id is None else doc_id, frames))

    def finish(self) -> None:
        index = zstandard.ZstdCompressor().compress(np.array(self.index, dtype="<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.seek, dtype="<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.seek), CHECKSUMS, FOOTER_MAGIC))


class Reader:
    """Random access to a file of :class:`Writer`; ``src`` has seek, read and size."""

    def __init__(self, src):
        self.src, end = src, src.size()
        src.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", src.read(9))
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a seekable token file")
        at = end - 9 - 12 * n - 8
        src.seek(at)
        head, size = struct.unpack("<II", src.read(8))
        if head != SEEK_MAGIC or size != 12 * n + 9:
            raise ValueError("broken seek table")
        self.table = np.frombuffer(src.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.table[:, 0])]) if n else np.zeros(1, np.int64)
        src.seek(int(self.offset[-1]))
        head, size = struct.unpack("<II", src.read(8))
        if head != INDEX_MAGIC:
            raise ValueError("broken index")
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(src.read(size)), dtype="<i8").reshape(-1, 2)
        self.first = np.cumsum(self.index[:, 1]) - self.index[:, 1]
        self.unpress = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> bytes:
        """Ids of the ``k``-th document; only its frames are fetched, decompressed and checked."""
        out = []
        for f in range(int(self.first[k]), int(self.first[k] + self.index[k, 1])):
            self.src.seek(int(self.offset[f]))
            plain = self.unpress.decompress(self.src.read(int(self.table[f, 0])), max_output_size=int(self.table[f, 1]) or 1)
            if len(plain) != self.table[f, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[f, 2]:
                raise ValueError(f"checksum of frame {f} does not match")
            out.append(plain)
        return b"".join(out)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            yield (None if self.index[k, 0] == NULL_ID else int(self.index[k, 0])), self.ids(k)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the ids of all documents, each followed by ``end_id``, in ascending doc_id order; returns the manifest.

    Documents are dealt by ranges of doc_id, so file ``part`` comes before ``part`` + 1. A task writes under a name
    of its own and the manifest lists only files of tasks that ended, so that a task that is run again does no harm.
    Manifest: part, file, n_docs, n_ids.

    Null or empty text: the end id alone. Null doc_id: kept, first in order. Repeated rows: all are written. Empty
    table: no files. Other columns are ignored. Very long texts take several frames.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "tokens")

    def run(batches):
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        out = w = None
        n_docs = n_ids = 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                if w is None:
                    fs, at = FileSystem.from_uri(path)
                    fs.create_dir(at, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.tok.zst"
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                    w = Writer(out)
                w.add(doc, ids + end)
                n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
        if w is not None:
            w.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"{path}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]})

    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return cut(dealt.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Documents of the files in a manifest, in the files' order: doc_id, start, n_tokens, ids (binary)."""
    files = with_base(manifest, "part", "n_ids").select("file", "base").repartition(manifest.count() or 1)

    def run(batches):
        for b in batches:
            for file, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_file(name) as src:
                    for doc, ids in Reader(src).documents():
                        rows.append((doc, at, len(ids) // 4, ids))
                        at, held = at + len(ids) // 4, held + len(ids)
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                yield _rows(rows)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def crc32_of(ids: DataFrame) -> DataFrame:
    """Unsigned CRC-32 of each document's ids."""
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
