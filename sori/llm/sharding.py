"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix (DataFrame functions only)."""

from __future__ import annotations

import json
import random
from math import exp, lgamma

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sori.llm.store import cut

#: Input partitions count as at most so many rows of the matrix (partition number modulo this), whatever the input.
MATRIX_ROWS = 4096
#: Parts in which a shard's rows are put in their final order.
SHARD_PARTS = 256


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items taken without replacement are good: exact inversion, searched outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    u, p = rng.random(), exp(choose(good, mode) + choose(bad, draws - mode) - choose(total, draws))
    up = down = mode
    above = below = p
    u -= p
    while u > 0 and (up < high or down > low):
        if up < high:
            above *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= above
            if u <= 0:
                return up
        if down > low:
            below *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= below
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard in a uniform shuffle; shard sizes differ by one at most."""
    rng, n = random.Random(seed), sum(rows)
    free = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = []
    for left in rows:
        line, room = [], sum(free)
        for s in range(shards):
            room -= free[s]
            k = hypergeometric(rng, free[s], room, left)
            line.append(k)
            left -= k
        for s in range(shards):
            free[s] -= line[s]
        matrix.append(line)
    return matrix


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240501) -> DataFrame:
    """Deal documents to shards: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    The law is ``rows``: numbers of rows differ by one at most. Every arrangement with these sizes is equally likely
    up to the quality of the seeded hashes. Partition totals (numbers only) meet in a matrix of exact hypergeometric
    draws; a partition's rows in a random order fill its line of the matrix; after the exchange each shard is put in
    another random order, in parts by the leading bits of the second key, whose totals give each part's first slot.
    Nothing random is drawn in a task, so a task that runs again gives the same rows.

    Null text: size 8, crc of nothing (0). Null doc_id: kept. Repeated rows: each gets a slot of its own, dealt independently of its copies. Empty
    table: no rows. Texts are never moved, only their sizes and checksums; other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    row = ("doc_id", "size", "text_crc32")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.spark_partition_id(), F.lit(MATRIX_ROWS)).alias("part"),
    )
    rows = cut(rows, "shard-rows")
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # at most MATRIX_ROWS numbers
    lines = []
    for (part, _), line in zip(counts, communication_matrix([n for _, n in counts], shards, seed), strict=True):
        lines.append({"part": part, "upto": [sum(line[: s + 1]) for s in range(shards)]})
    matrix = spark.sql("SELECT inline(from_json(:lines, 'array<struct<part:int,upto:array<bigint>>>'))", args={"lines": json.dumps(lines)})
    copy = F.row_number().over(Window.partitionBy("part", *row).orderBy("part"))  # tells rows apart that are equal
    rows = rows.withColumn("copy", copy)
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), *row, "copy"), *row, "copy")
    dealt = rows.withColumn("r", F.row_number().over(local)).join(F.broadcast(matrix), "part")  # MATRIX_ROWS lines at most
    key = F.xxhash64(F.lit(seed + 1), *row, "part", "copy")
    dealt = dealt.select(*row, F.size(F.filter("upto", lambda x: x < F.col("r"))).cast("int").alias("shard"), key.alias("key"))
    dealt = cut(dealt.withColumn("sub", F.shiftrightunsigned("key", 56).cast("int")), "shard-dealt")
    parts = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("cell", F.col("shard") * SHARD_PARTS + F.col("sub"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("shard", "sub").orderBy("key", *row)
    placed = dealt.withColumn("place", F.row_number().over(order))
    # shards * SHARD_PARTS rows at most
    return placed.join(F.broadcast(parts), ["shard", "sub"]).select(*row, "shard", (F.col("base") + F.col("place") - 1).cast("long").alias("slot"))
