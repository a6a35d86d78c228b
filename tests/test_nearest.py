"""The index of pivots against plain search: same neighbours, far fewer rows compared where vectors lie in clusters."""

import random

from pyspark.sql import functions as F

from sori.operators.nearest import index, nearest, nearest_indexed


def clustered(n=1500, labels=2, clusters=12, d=8, seed=3):
    r = random.Random(seed)
    centres = [[r.uniform(-10, 10) for _ in range(d)] for _ in range(clusters)]
    return [(i, [c + r.gauss(0, 0.3) for c in centres[r.randrange(clusters)]], i % labels) for i in range(n)]


def test_index_finds_the_same_and_compares_less(spark):
    rows = clustered()
    rows += [(2000 + i, rows[0][1], 0) for i in range(6)]  # equal vectors: ties go to the smaller id
    rows += [(3000, [1.0] * 8, 7), (3001, [2.0] * 8, 7), (3002, [0.0] * 8, 8)]  # values with fewer rows than asked for
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = df.where("vec_id % 25 = 0 OR vec_id > 1999").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    want = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in nearest(queries, df, 4).collect()}
    best, compared = nearest_indexed(queries, index(df, pivots=16, rings=12), 4)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in best.collect()} == want
    visited = compared.agg(F.sum("compared")).first()[0]
    every = queries.join(df.groupBy("label").count(), "label").agg(F.sum("count")).first()[0]
    assert visited < every / 3, (visited, every)


def test_pairs_never_carry_vectors(spark, tmp_path):
    """Copies, null vectors and more rows than a block; what is exchanged after vectors met are ids and distances, k from each block."""
    from sori.operators import nearest as N

    rows = clustered(n=300) + [(1000 + i, [0.5] * 8, 0) for i in range(50)] + [(2000, None, 0), (2001, [1.0] * 8, None), (2002, None, 9), (2003, [2.0] * 8, 9), (2004, [None, *[1.0] * 7], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = df.where("vec_id % 10 = 0 AND embedding IS NOT NULL OR vec_id = 2003").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    want = {}
    for i, q, label in ((r.query_id, r.q, r.label) for r in queries.collect()):
        apart = lambda v: round(sum((a - b) ** 2 for a, b in zip(q, v)) ** 0.5, 9) if v and None not in v else None  # noqa: B023, E731
        near = sorted(((apart(v), j) for j, v, own in rows if own == label and label is not None and j != i), key=lambda t: (t[0] is None, t))
        want |= {(i, r): (j, d) for r, (d, j) in enumerate(near[:3], 1)}
    before, N.BLOCK = N.BLOCK, 20
    try:
        met = N._met(queries, df, ["label"], 3, 4)
        best = nearest(queries, df, 3)
        assert {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in best.collect()} == want
    finally:
        N.BLOCK = before
    assert met.columns == ["query_id", "vec_id", "distance"]
    assert met.where("query_id BETWEEN 1000 AND 1049").groupBy("query_id").count().agg(F.max("count")).first()[0] < 3 * 40  # not every copy
