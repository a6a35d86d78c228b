"""What search and near-duplicate operators on embeddings share: valid vectors and blocks along a sorted key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sori.llm.store import cut

#: Bins of the key's range in which rows are counted to place block borders.
BINS = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is not null, not empty and holds finite numbers only."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays of doubles."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def sorted_blocks(rows: DataFrame, groups: list[str], key: str, low: float, high: float, block_rows: int, name: str) -> DataFrame:
    """Cut each group's rows, sorted by ``key``, into blocks of about ``block_rows``; adds the column block.

    Counts in bins of the key's range (BINS for each group at most) are summed to ranks; rows of one bin that holds
    more than a block are dealt on by a hash of id. No group is sorted or collected in one task.
    """
    bin_ = F.least(F.greatest(F.floor((F.col(key) - low) / ((high - low) or 1.0) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    rows = rows.withColumn("_bin", bin_)
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*groups, "_bin").agg(F.count("*").alias("_n"))
    bins = bins.withColumn("_ring", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / block_rows)).withColumn("_parts", F.ceil(F.col("_n") / block_rows))
    bins = cut(bins.select(*groups, "_bin", "_ring", "_parts"), f"{name}-bins")
    part = F.pmod(F.xxhash64("id"), F.col("_parts"))
    return rows.join(bins, [*groups, "_bin"]).withColumn("block", F.xxhash64(*groups, "_ring", part)).drop("_bin", "_ring", "_parts")
