"""Exact nearest neighbours under a metadata filter, with and without an index of pivots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sori.sources.shared import shared_path

#: Parts that the candidates of a filter value are dealt to, so that a hot value spreads over tasks.
PARTS = 32
#: Rows and queries that meet in one block at most (about), so that no task holds more whatever a value has.
BLOCK = 4096


def euclidean(x: Column, y: Column) -> Column:
    square = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))


def _stacked(values: pd.Series) -> np.ndarray:
    """Vectors as one matrix; those that are null, hold a null or have another length than the first are all NaN."""
    rows = [None if v is None else np.asarray(v, float) for v in values]
    size = next((len(v) for v in rows if v is not None), 0)
    gone = np.full(size, np.nan)
    return np.array([gone if v is None or len(v) != size else v for v in rows]).reshape(len(rows), size)


def block_nearest(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For a block of queries (query_id, q) and one of rows (vec_id, embedding): each query's ``k`` nearest rows and ties, itself excluded.

    Products of matrices rule out what is farther than the k-th by more than rounding may explain; distances of the rest
    are summed in the order of components, as :func:`euclidean` does. Distances that are no numbers are null and last.
    """

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "distance": np.zeros(0)})
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values("vec_id")
        ids, asked = rows.vec_id.to_numpy(), queries.query_id.to_numpy()
        x, every = _stacked(rows.embedding), _stacked(queries.q)
        if x.shape[1] != every.shape[1]:
            x, every = np.full((len(x), 1), np.nan), np.full((len(every), 1), np.nan)
        out = [empty]
        with np.errstate(invalid="ignore", over="ignore"):
            norms = (x * x).sum(1)
            for start in range(0, len(every), 256):
                q, own = every[start : start + 256], asked[start : start + 256]
                size = (q * q).sum(1)[:, None] + norms
                square = size - 2 * (q @ x.T)
                slack = 1e-8 * (1 + size)
                bad = ~np.isfinite(square)
                low, high = np.where(bad, np.inf, square - slack), np.where(bad, np.inf, square + slack)
                same = own[:, None] == ids
                low[same] = high[same] = np.inf
                kth = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, min(k, high.shape[1]) - 1]
                some = low <= np.where(np.isfinite(kth), kth, -np.inf)[:, None]
                for i in np.flatnonzero(~np.isfinite(kth)):  # fewer than k numbers: all of them, then the first of the rest
                    some[i] = np.isfinite(low[i])
                    some[i, np.flatnonzero(bad[i] & ~same[i])[: k]] = True
                i, j = np.nonzero(some)
                total = np.zeros(len(i))
                for c in range(x.shape[1]):
                    total += (q[i, c] - x[j, c]) * (q[i, c] - x[j, c])
                found = pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "distance": np.sqrt(total)})
                out.append(found[found.groupby(["query_id", "distance"], dropna=False).cumcount() < k])  # of copies the first k; rows come by id
        return pd.concat(out)

    return best


PAIRS = "query_id long, vec_id long, distance double"


def _ranked(pairs: DataFrame, k: int, *by: str | Column) -> DataFrame:
    """Each group's ``k`` nearest of ``pairs``, by distance (none last) and id."""
    order = Window.partitionBy("query_id", *by).orderBy(F.asc_nulls_last("distance"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "label") -> DataFrame:
    """The ``k`` nearest rows with the same ``key`` as each query, itself excluded; ties to smaller ids.

    ``queries`` has query_id, q and the key; ``rows`` has vec_id, embedding and the key. Rows and queries of a key are
    dealt to blocks of bounded size; vectors travel once for each block that they meet, never for each pair. Each block
    keeps a query's own k nearest before the blocks of a query meet, so what is sorted last is queries times blocks
    times k. Distances that are null come last.
    """
    return _ranked(_met(queries, rows, [key], k, PARTS), k)


def _met(queries: DataFrame, rows: DataFrame, cell: list[str], k: int, least: int = 1) -> DataFrame:
    """The nearest of the rows that have a query's ``cell``, ``k`` (and near ties) from each of their blocks."""
    blocks = lambda df, name, n: df.dropna(subset=cell).groupBy(*cell).agg(F.greatest(F.lit(n), F.ceil(F.count("*") / BLOCK)).cast("int").alias(name))
    sizes = blocks(rows, "parts", least).join(blocks(queries, "groups", 1), cell)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [F.col(c).alias(f"own_{c}") for c in cell]  # both sides may come from one table
    asked = queries.join(sizes, cell).select("query_id", "q", *own, deal("query_id", "groups").alias("group"), every("parts").alias("part"))
    dealt = rows.join(sizes, cell).select("vec_id", "embedding", *cell, deal("vec_id", "parts").alias("part"), every("groups").alias("group"))
    pairs = asked.groupBy(*(f"own_{c}" for c in cell), "group", "part").cogroup(dealt.groupBy(*cell, "group", "part")).applyInPandas(block_nearest(k), PAIRS)
    return pairs.withColumn("distance", F.round("distance", 9))


#: Pivots of a filter value, and rings around each.
PIVOTS, RINGS = 16, 24
#: What rounding may take from a distance; bounds are widened by it.
SLACK = 1e-6


@dataclass
class Index:
    """Rows by their nearest pivot and ring, and what each ring holds; both are written tables."""

    pivots: DataFrame  # key, pivot, p
    rows: DataFrame  # vec_id, embedding, key, pivot, ring
    rings: DataFrame  # key, pivot, ring, low, high, n
    key: str


def index(rows: DataFrame, key: str = "label", pivots: int = PIVOTS, rings: int = RINGS) -> Index:
    """Key every row by the nearest of its filter value's pivots and the ring, by distance, that it lies in.

    ``rows`` has vec_id, embedding and the key. Pivots are ``pivots`` rows of each value, by a hash of their ids; every
    row is compared with them only. Rings cut a pivot's distances into equal steps.
    """
    order = Window.partitionBy(key).orderBy("h", "vec_id")
    part = F.pmod(F.col("h"), F.lit(PARTS))
    picked = rows.where("embedding IS NOT NULL").select(key, "vec_id", "embedding", F.xxhash64("vec_id").alias("h"))
    picked = picked.withColumn("_r", F.row_number().over(Window.partitionBy(key, part).orderBy("h", "vec_id"))).where(F.col("_r") <= pivots)  # no value is sorted in one task
    picked = picked.withColumn("pivot", F.row_number().over(order)).where(F.col("pivot") <= pivots)
    found = _written(picked.select(key, "pivot", F.col("embedding").alias("p")), "pivots")
    own = found.groupBy(key).agg(F.collect_list(F.struct("pivot", "p")).alias("pivots"))  # ``pivots`` at most
    near = rows.select("vec_id", "embedding", key).join(own, key)
    near = near.withColumn("near", F.array_min(F.transform("pivots", lambda x: F.struct(euclidean(F.col("embedding"), x["p"]).alias("d"), x["pivot"].alias("pivot")))))
    near = _written(near.select("vec_id", "embedding", key, "near.pivot", "near.d"), "near")
    far = near.groupBy(key, "pivot").agg(F.max("d").alias("far"))
    keyed = near.join(far, [key, "pivot"]).withColumn("ring", F.least(F.floor(F.col("d") * rings / F.greatest("far", F.lit(1e-12))), F.lit(rings - 1)).cast("int"))
    keyed = _written(keyed.select("vec_id", "embedding", key, "pivot", "ring", "d"), "keyed")
    held = keyed.groupBy(key, "pivot", "ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))
    return Index(found, keyed.drop("d"), _written(held, "rings"), key)


def nearest_indexed(queries: DataFrame, idx: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """What :func:`nearest` returns, and how many rows each query was compared with (query_id, compared).

    A ring around a pivot can hold nothing nearer to a query than the gap between the query's own distance to the pivot
    and the ring. Queries first visit their rings of least gap until these hold k rows; then those whose gap is within
    the k-th distance found, nearest first, up to eight times as many rows; then all others whose gap is still within.
    What is left out can't be among the k nearest, so the result is exact.
    """
    key = idx.key
    own = queries.select("query_id", "q", key).join(idx.pivots, key).select("query_id", key, "pivot", euclidean(F.col("q"), F.col("p")).alias("d"))
    gap = F.greatest(F.lit(0.0), F.col("d") - F.col("high"), F.col("low") - F.col("d")) - SLACK
    gaps = own.join(idx.rings, [key, "pivot"]).select("query_id", key, "pivot", "ring", "n", gap.alias("gap"))
    before = Window.partitionBy("query_id").orderBy("gap", "pivot", "ring").rowsBetween(Window.unboundedPreceding, -1)  # a query's rings: a few hundred
    gaps = _written(gaps.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "gaps")

    def visit(chosen: DataFrame, name: str) -> DataFrame:
        asked = chosen.select("query_id", key, "pivot", "ring").join(queries.select("query_id", "q"), "query_id")
        return _best(_met(asked, idx.rows, [key, "pivot", "ring"], k), k, name)

    first = F.col("before") < k + 1  # one more, as the query itself may be stored
    best = visit(gaps.where(first), "first")
    chosen = gaps.where(first)
    for limit in (8 * (k + 1), None):
        worst = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("worst"))
        within = F.col("worst").isNull() | (F.col("gap") <= F.col("worst"))
        rest = gaps.where(~first).join(worst, "query_id", "left").where(within).drop("worst")
        now = rest if limit is None else rest.where(F.col("before") < limit)
        first = first | (F.col("before") < limit) if limit else first
        chosen = chosen.unionByName(now)
        best = _best(best.unionByName(visit(now, "more")), k, "best")
    compared = chosen.groupBy("query_id").agg(F.sum("n").alias("compared"))
    return _ranked(best, k), compared


def _best(pairs: DataFrame, k: int, name: str) -> DataFrame:
    """Each query's k nearest of ``pairs``: those of every part first, so that no query is sorted as a whole."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(PARTS))
    return _written(_ranked(_ranked(pairs, k, part), k).select("query_id", "vec_id", "distance"), name)


def _written(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = shared_path(spark, f"nearest-{name}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
