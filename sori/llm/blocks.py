"""Exact verification of candidate pairs in blocks of bounded size, for similarity joins on bucket keys."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.store import cut, drop_table, heavy

#: Buckets of up to so many members give pairs at once; larger ones are taken in blocks.
SMALL_BUCKET = 16
#: Amount (as given by the caller's ``size``) that a block holds, about.
BLOCK_AMOUNT = 60_000

Verify = Callable[[list[int], list[bytes], int], list[tuple[int, int]]]


def shared_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, id) whose key has two ids or more, with their number n; ``rows`` must be cheap to make twice."""
    rows = rows.select("key", "id")
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-counts")
    return cut(rows.join(counts, "key"), "shared-keys")


def candidate_blocks(shared: DataFrame, sizes: DataFrame, min_shared: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of the ids that have candidates, and the pairs of blocks between which there are candidates.

    ``shared`` has key, id, n; ``sizes`` has id, size. Two ids are candidates if they share a large bucket, or at
    least ``min_shared`` small ones. An id's block follows its smallest key, so that most ids that belong together
    lie together; blocks that grow beyond BLOCK_AMOUNT are dealt on by a hash of the id. No pair of ids of a large
    bucket is ever written out: only its blocks are paired.
    """
    small = shared.where(F.col("n") <= SMALL_BUCKET).select("key", "id")
    other = small.select("key", F.col("id").alias("b"))
    pairs = small.withColumnRenamed("id", "a").join(other, "key").where("a < b").groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= min_shared)
    pairs = cut(pairs.select("a", "b", F.xxhash64("a", "b").alias("key")), "candidates")
    large = shared.where(F.col("n") > SMALL_BUCKET).select("key", "id")
    groups = large.unionByName(pairs.select("key", F.col("a").alias("id"))).unionByName(pairs.select("key", F.col("b").alias("id")))
    groups = cut(groups, "groups")
    labels = cut(groups.groupBy("id").agg(F.min("key").alias("label")).join(sizes, "id"), "labels")
    amounts = cut(labels.groupBy("label").agg(F.ceil(F.sum("size") / BLOCK_AMOUNT).alias("parts")), "amounts")
    part = F.pmod(F.xxhash64(F.lit(5), "id"), F.greatest("parts", F.lit(1)))
    members = cut(labels.join(amounts, "label").select("id", F.xxhash64("label", part).alias("block")), "members")
    touched = cut(groups.join(members, "id").select("key", "block").distinct(), "touched")
    pairs_of_blocks = touched.withColumnRenamed("block", "x").join(touched.withColumnRenamed("block", "y"), "key").where("x <= y").select("x", "y").distinct()
    made = cut(pairs_of_blocks, "block-pairs")
    for t in (pairs, groups, labels, amounts, touched):
        drop_table(t)
    return members, made


def verified_edges(members: DataFrame, block_pairs: DataFrame, payloads: DataFrame, verify: Verify) -> DataFrame:
    """Links (a, b) that ``verify`` finds within blocks and between paired blocks.

    ``payloads`` has id, payload. ``verify(ids, payloads, split)`` compares every id with every one of another
    half (or, if ``split`` is 0, with every other id) exactly and returns enough of the links to connect all that are
    linked: no link between different components is left out.
    """
    spark = members.sparkSession
    grouped = payloads.join(members, "id").groupBy("block").agg(F.collect_list(F.struct("id", "payload")).alias("rows"))  # bounded by BLOCK_AMOUNT
    blocks = cut(grouped, "blocks")
    paired = block_pairs.join(blocks.select(F.col("block").alias("x"), F.col("rows").alias("left")), "x")
    right = blocks.select(F.col("block").alias("y"), F.col("rows").alias("right"))
    lonely = paired.where("x = y").select("left", F.lit(None).cast(right.schema["right"].dataType).alias("right"))
    jobs = lonely.unionByName(paired.where("x < y").join(right, "y").select("left", "right"))

    def run(batches):
        for b in batches:
            a, z = [], []
            for left, other in zip(b.column(0), b.column(1), strict=True):
                rows = [*(left.as_py() or []), *(other.as_py() or [])]
                split = len(left) if other.is_valid else 0
                for p, q in verify([r["id"] for r in rows], [r["payload"] for r in rows], split):
                    a.append(p)
                    z.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    with heavy(spark, 16):
        edges = cut(jobs.mapInArrow(run, "a long, b long"), "links")
    drop_table(blocks)
    return edges


def forest(ids: list[int], candidates) -> list[tuple[int, int]]:
    """Links of a spanning forest. ``candidates(k, group)`` gives the places of k's partners, given each place's group."""
    group, out = np.arange(len(ids)), []
    for k in range(len(ids)):
        for p in candidates(k, group):
            if group[p] != group[k]:
                group[group == group[p]] = group[k]
                out.append((ids[k], ids[p]))
    return out
