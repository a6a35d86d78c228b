"""Connected components of links between documents, as joins and groupings (union-find by alternating stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.store import cut, drop_table


def components(edges: DataFrame) -> DataFrame:
    """Members of the components of a graph and each component's smallest member: id, component.

    ``edges`` has long columns a and b; loops and repeated edges do no harm, nodes without an edge are not returned.
    Each round hangs every node's larger neighbours on its smallest one (large star) and then every node with its
    smaller neighbours on the smallest of these (small star), until nothing changes: a number of rounds about the
    logarithm of the longest path. Minima are pre-aggregated and written before they are joined, so that a hot
    node's edges are a plain skewed join, which Spark splits; the driver gets a count and a checksum each round.
    """
    ends = (F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = cut(edges.where("a <> b").select(*ends).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m")), "least")
        large = now.join(least, "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        roots = cut(large.groupBy("u").agg(F.min("v").alias("m")), "roots")
        small = large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(roots.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for t in (now, least, large, roots):
            drop_table(t)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)
