"""Embedding near-duplicates by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori.llm.graph import components
from sori.llm.store import cut, drop_table, small_batches
from sori.llm.vectors import finite, matrix, sorted_blocks

PROJECTIONS, BLOCK_ROWS, SEED = 32, 1024, 11
#: A pair at the threshold may fall short of the count, or out of the blocks' window, with so small a probability.
MISS = 2e-5


def calibrate(cosine: float, projections: int = PROJECTIONS, miss: float = MISS) -> tuple[float, int, float]:
    """Half-width of the windows, the count that a pair must reach, and the reach of the first projection.

    Two unit vectors at the threshold differ by a vector of length sqrt(2 - 2 cosine); on a Gaussian direction that
    is a normal variable of this deviation, so collisions of the pair are binomial. Closer pairs collide more often.
    """
    length = sqrt(max(0.0, 2 - 2 * cosine)) or 1e-6
    p = erf(1 / sqrt(2))  # a window of one deviation to each side
    below, count = 0.0, 0
    while below + comb(projections, count) * p**count * (1 - p) ** (projections - count) <= miss:
        below += comb(projections, count) * p**count * (1 - p) ** (projections - count)
        count += 1
    return length, count, 5.0 * length


def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, projections))


def colliding(a: np.ndarray, b: np.ndarray, half: float, count: int) -> list[np.ndarray]:
    """For each row of ``a`` (projections of queries) the rows of ``b`` that fall into at least ``count`` of its windows."""
    order = np.argsort(b, axis=0, kind="stable")
    lows, highs, columns = [], [], []
    for k in range(b.shape[1]):
        ranked = b[order[:, k], k]
        lows.append(np.searchsorted(ranked, a[:, k] - half, "left"))
        highs.append(np.searchsorted(ranked, a[:, k] + half, "right"))
        columns.append(np.ascontiguousarray(order[:, k]))
    out = []
    for i in range(len(a)):
        hits = np.concatenate([c[lo[i] : hi[i]] for c, lo, hi in zip(columns, lows, highs, strict=True)])
        out.append(np.flatnonzero(np.bincount(hits, minlength=len(b)) >= count))
    return out


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """Links of vectors of one label with at least this cosine: vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class with a multiplicity. Each class is projected on PROJECTIONS random
    directions. A label's classes, sorted along the first projection, lie in blocks; blocks within reach of each
    other are paired, and for each vector the others that fall into its windows of the sorted projections are counted.
    Pairs that reach the calibrated count are verified by their cosine in doubles. A task returns sums of links and the
    links of a spanning forest, never all pairs.

    ``n_links`` counts other rows linked directly (equal ones included), ``component_id`` is the smallest vec_id that
    links reach, itself included, ``kept`` marks it. Null label; null, empty or zero vectors; null or non-finite
    components: linked with nothing. Null vec_id: takes no part, component_id null, kept true. Rows that share a
    vec_id are one node, each row is returned. Vectors of unlike length are not compared. Empty table: no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    half, count, reach = calibrate(cosine)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), v.alias("v"))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = cut(rows.select("vec_id", "label", F.when(good, F.col("v")).alias("v")), "vectors")
    classes = cut(rows.where("v IS NOT NULL").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")

    def project(batches):
        known: dict[int, np.ndarray] = {}
        for b in batches:
            vs = matrix(b.column(1))
            for x in vs:
                if len(x) not in known:
                    known[len(x)] = directions(len(x))
            p = []
            for x in vs:
                big = np.abs(x).max()
                p.append((x / big / np.linalg.norm(x / big)) @ known[len(x)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in vs], pa.binary()), pa.array([len(x) for x in vs], pa.int32()), pa.array([float(x[0]) for x in p]), pa.array([x.tobytes() for x in p], pa.binary()), b.column(2), b.column(3)], ["id", "v", "dim", "first", "p", "n", "label"])

    placed = classes.select("id", "v", "n", "label").mapInArrow(project, f"id long, v binary, dim int, first double, p binary, n long, label {rows.schema['label'].dataType.simpleString()}")
    placed = cut(placed, "projections")
    dealt = sorted_blocks(placed, ["label", "dim"], "first", -5.0, 5.0, BLOCK_ROWS, "projections")
    fields = F.collect_list(F.struct("id", "n", "v", "p")).alias("rows")
    blocks = cut(dealt.groupBy("label", "dim", "block").agg(F.min("first").alias("low"), F.max("first").alias("high"), fields), "projection-blocks")
    meta = blocks.select("label", "dim", "block", "low", "high")
    other = meta.toDF("label", "dim", "y", "low_y", "high_y")
    near = (F.col("low") - F.col("high_y") <= reach) & (F.col("low_y") - F.col("high") <= reach) & (F.col("block") <= F.col("y"))
    pairs = cut(meta.join(other, ["label", "dim"]).where(near).select(F.col("block").alias("x"), "y"), "projection-pairs")
    paired = pairs.join(blocks.select(F.col("block").alias("x"), F.col("rows").alias("left")), "x")
    jobs = paired.join(blocks.select(F.col("block").alias("y"), F.col("rows").alias("right")), "y").select("left", "right", (F.col("x") == F.col("y")).alias("same"))

    def unpack(group: list[dict]) -> tuple:
        x, p = np.array([np.frombuffer(r["v"]) for r in group]), np.array([np.frombuffer(r["p"]) for r in group])
        return np.array([r["id"] for r in group]), np.array([r["n"] for r in group]), x, p

    def count_links(batches):
        for b in batches:
            out: list[tuple] = []
            for left, right, same in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                a_ids, a_n, a, a_p = unpack(left)
                b_ids, b_n, z, b_p = (a_ids, a_n, a, a_p) if same else unpack(right)
                a_norm, b_norm = np.sqrt((a * a).sum(axis=1)), np.sqrt((z * z).sum(axis=1))
                a_sum, b_sum = np.zeros(len(a), np.int64), np.zeros(len(z), np.int64)
                group = np.arange(len(a) + (0 if same else len(z)))
                for i, hits in enumerate(colliding(a_p, b_p, half, count)):
                    hits = hits[hits > i] if same else hits
                    if not len(hits):
                        continue
                    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                        hits = hits[(z[hits] @ a[i]) / (a_norm[i] * b_norm[hits]) >= cosine]
                    a_sum[i] += b_n[hits].sum()
                    b_sum[hits] += a_n[i]
                    for j in hits:
                        g = j if same else len(a) + j
                        if group[g] != group[i]:
                            group[group == group[g]] = group[i]
                            out.append((int(a_ids[i]), int(b_ids[j]), None))
                sums = [(a_ids, a_sum + b_sum)] if same else [(a_ids, a_sum), (b_ids, b_sum)]
                out += [(int(ids[i]), None, int(total[i])) for ids, total in sums for i in np.flatnonzero(total)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n"])

    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        links = cut(jobs.mapInArrow(count_links, "a long, b long, n long"), "vector-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    groups = cut(components(links.where("b IS NOT NULL").select("a", "b")), "vector-groups")
    sums = links.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    facts = classes.join(sums, "id", "left").join(groups, "id", "left")
    facts = cut(facts.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-facts")
    for t in (placed, blocks, pairs):
        drop_table(t)
    out = rows.join(facts, ["label", "v"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
