"""Packing: concatenate and cut."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.store import cut, small_batches, with_base
from sori.llm.tokens import encoder

TOKENS = "doc_id long, part int, local_start long, doc_tokens long, ids binary"


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids of every document with the end id, and where they lie among its partition's ids (first pass)."""
    small_batches(docs.sparkSession)

    def run(batches):
        enc, part, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            small = [np.frombuffer(x, dtype="<u4") for x in ids]
            packed = [(x.astype("<u2") if x.max() < 65536 else x).tobytes() for x in small]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(starts), pa.array(n), pa.array(packed, pa.binary())], ["doc_id", "part", "local_start", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pack documents into sequences of ``length`` ids without padding between them.

    First pass: every partition tokenises its documents, notes where each starts in the partition and writes that to
    the shared folder. The partitions' totals (one small row each) are summed to the offset at which a partition
    starts in the whole. Second pass: a document's global start tells which fixed windows it crosses; it gives one
    boundary record, a piece, for each. All sequences but the last are full; that one is padded, unless its length
    is a power of two.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit),
    continues (the document goes on in the next sequence).

    Null or empty text: only the end id. Null doc_id: kept. Repeated rows: each is packed. Empty table: no rows.
    Other columns are ignored. A very long text gives many pieces, made one at a time.
    """
    table = cut(tokenised(docs, tokenizer_path, end_id), "packing")
    totals = table.groupBy("part").agg(F.max(F.col("local_start") + F.col("doc_tokens")).alias("total"))
    bases = with_base(totals, "part", "total").select("part", "base")

    def pieces(batches):
        for b in batches:
            rows = []
            for doc, first, n, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                done = 0
                while done < n:
                    at = first + done
                    take = min(n - done, length - at % length)
                    cut_ids = ids[done : done + take].tobytes()
                    rows.append((doc, done, take, zlib.crc32(cut_ids), n, at // length, at % length, cut_ids, done + take < n))
                    done += take
                    if len(rows) >= 8192:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    # One row of 12 bytes for each input partition: the broadcast is bounded by the number of tasks, not by the data.
    placed = table.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("first"), "doc_tokens", "ids")
    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, continues boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.bool_()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "continues"]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
