"""Exact top-k search by inner product, over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sori.llm.store import cut, drop_table, small_batches
from sori.llm.vectors import finite, matrix, sorted_blocks

#: Pivots, and rows of the sample from which they are taken (the smallest hashes of id); these fit the index only.
PIVOTS, SAMPLE_ROWS = 32, 4096
BLOCK_ROWS, QUERY_ROWS = 2048, 256
#: Annuli that a query block visits in the first expansion.
FIRST_ANNULI = 3
#: Queries' blocks are spread over so many parts when they meet the annuli's bounds.
SPREAD = 16


def pivots_of(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest-first points of a sample: well spread pivots."""
    chosen = [0]
    far = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact, else in 64-bit integers."""
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def top_k(vectors: DataFrame, query_every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The ``k`` rows of the largest inner product for each query: query_id, rank (from 1), vec_id, score.

    Components count as floor(scale * x). Queries are the rows whose vec_id is divisible by ``query_every``;
    candidates are all rows but those of the query's own vec_id. Equal scores go to the smaller vec_id.

    With one more component sqrt(M^2 - |x|^2), M the largest norm, the largest inner product is the smallest
    distance. Every row is keyed by its nearest pivot and its distance to it; a pivot's rows, sorted by that distance,
    are cut into annuli of about BLOCK_ROWS rows. By the triangle inequality a query at distance d of the pivot is at
    least max(d - outer, inner - d) from all rows of an annulus. A first expansion takes each query block's nearest
    annuli and gives each query a k-th score; the second takes every annulus that its bound does not rule out, and in
    it only the queries that it is not ruled out for. What is emitted are at most k rows for each query and annulus.

    Vectors that are null, empty, or hold null or non-finite components take no part; nor do rows without vec_id.
    Vectors meet only vectors of their own length. Rows that share a vec_id are candidates each. Inner products must fit
    64-bit integers. Empty table or no queries: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vec = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull()).where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), vec.alias("v"))
    rows = rows.withColumn("dim", F.size("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = cut(rows, "search-rows")
    largest = rows.agg(F.max("norm2")).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if largest is None:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect()  # SAMPLE_ROWS vectors at most
    pivots = {d: pivots_of(np.array([[*r["v"], np.sqrt(max(0.0, largest - r["norm2"]))] for r in sample if r["dim"] == d])) for d in {r["dim"] for r in sample}}

    def around(v: np.ndarray, extra: float) -> np.ndarray:
        p = pivots.get(len(v), np.zeros((1, len(v) + 1)))
        return np.sqrt(((p - np.append(v, extra)) ** 2).sum(axis=1))

    def keyed(batches):
        for b in batches:
            ids, vs, norms = b.column(0), matrix(b.column(1)), b.column(2).to_numpy()
            near = [around(v, np.sqrt(max(0.0, largest - n))) for v, n in zip(vs, norms, strict=True)]
            p = [int(d.argmin()) for d in near]
            raw = [v.tobytes() for v in vs]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(v) for v in vs], pa.int32()), pa.array(p, pa.int32()), pa.array([float(d[i]) for d, i in zip(near, p, strict=True)]), pa.array(raw, pa.binary())], ["id", "dim", "pivot", "dist", "v"])

    index = cut(rows.select("id", "v", "norm2").mapInArrow(keyed, "id long, dim int, pivot int, dist double, v binary"), "search-index")
    low, high = index.agg(F.min("dist"), F.max("dist")).first()
    dealt = sorted_blocks(index, ["dim", "pivot"], "dist", low, high, BLOCK_ROWS, "search")
    annuli = cut(dealt.groupBy("dim", "pivot", "block").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"), F.collect_list(F.struct("id", "v")).alias("rows")), "annuli")

    asked = index.where(F.col("id") % query_every == 0)
    sizes = asked.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    asked = asked.join(sizes, ["dim", "pivot"]).withColumn("q", F.xxhash64("dim", "pivot", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts"))))
    asked = asked.groupBy("dim", "q").agg(F.collect_list(F.struct("id", "v")).alias("asked"))

    def spans(batches):
        for b in batches:
            for dim, q, group in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                d = np.array([around(np.frombuffer(r["v"]), 0.0) for r in group])
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "q": [q], "asked": pa.array([group], b.schema.field("asked").type), "near": [d.min(axis=0).tolist()], "far": [d.max(axis=0).tolist()]})

    asked = cut(asked.mapInArrow(spans, "dim int, q long, asked array<struct<id:long,v:binary>>, near array<double>, far array<double>"), "search-queries")
    spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("s")
    left = asked.select("dim", "q", "near", "far", F.pmod("q", F.lit(SPREAD)).cast("int").alias("s"))
    pairs = annuli.select("dim", "pivot", "block", "inner", "outer", spread).join(left, ["dim", "s"])
    bound = F.greatest(F.lit(0.0), F.col("near")[F.col("pivot")] - F.col("outer"), F.col("inner") - F.col("far")[F.col("pivot")])
    pairs = cut(pairs.select("q", "block", bound.alias("bound")), "search-pairs")

    def visit(batches):
        for b in batches:
            out: list[tuple] = []
            for group, block, pivot, inner, outer, least in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                floor_ = dict(zip((x["id"] for x in least or []), (x["score"] for x in least or []), strict=True))
                q, x = np.array([np.frombuffer(r["v"]) for r in group]), np.array([np.frombuffer(r["v"]) for r in block])
                q_ids, ids = np.array([r["id"] for r in group]), np.array([r["id"] for r in block])
                d = np.array([around(v, 0.0)[pivot] for v in q])
                gap = np.maximum(0.0, np.maximum(d - outer, inner - d)) * (1 - 1e-9)
                most = ((q * q).sum(axis=1) + largest - gap * gap) / 2  # no inner product with a row of the annulus is larger
                lows = np.array([floor_.get(int(i), -(2.0**62)) for i in q_ids])
                go = np.flatnonzero(most + 1e-6 * np.abs(most) + 1 >= lows)
                if not len(go):
                    continue
                s = scores(q[go], x)
                order = np.argsort(ids, kind="stable")
                s, ids = s[:, order], ids[order]
                for line, at in zip(s, go, strict=True):
                    fit = np.flatnonzero((line >= lows[at]) & (ids != q_ids[at]))
                    if len(fit) > k:
                        kth = np.partition(line[fit], len(fit) - k)[len(fit) - k]
                        fit = fit[line[fit] >= kth]
                    fit = fit[np.argsort(-line[fit], kind="stable")[:k]]
                    out += [(int(q_ids[at]), int(i), int(y)) for i, y in zip(ids[fit], line[fit], strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def expand(chosen: DataFrame, queries: DataFrame, name: str) -> DataFrame:
        jobs = chosen.join(annuli.select("block", "pivot", "inner", "outer", "rows"), "block").join(queries, "q").select("asked", "rows", "pivot", "inner", "outer", "least")
        held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        try:
            return cut(jobs.mapInArrow(visit, "query_id long, vec_id long, score long"), name)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    nearest = Window.partitionBy("q").orderBy("bound", "block")
    first = pairs.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= FIRST_ANNULI).select("q", "block")
    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    found = expand(first, asked.select("q", "asked", none.alias("least")), "search-first")
    kth = found.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select(F.col("query_id").alias("id"), "score")
    members = asked.select("q", F.explode("asked.id").alias("id")).join(kth, "id", "left")
    limits = cut(members.groupBy("q").agg(F.collect_list(F.struct("id", F.coalesce("score", F.lit(-(2**62))).alias("score"))).alias("least")), "search-limits")
    # A block is out for a whole query block if even the lowest k-th score of its queries rules it out; the task tells for each query.
    found = expand(pairs.select("q", "block"), asked.select("q", "asked").join(limits, "q"), "search-rest")
    for t in (rows, index, annuli, pairs):
        drop_table(t)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
