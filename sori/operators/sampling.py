"""Samples with quotas, batches, whole-group prefixes, apportionment. Order is by a hash, so every run draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that a stratum is dealt to.
PARTS = 64


def drawn(key: str, seed: int) -> Column:
    """Order in which rows are drawn."""
    return F.md5(F.concat_ws(":", F.lit(seed), key))


def quota_sample(rows: DataFrame, stratum: list[str], key: str, quota: Column, seed: int) -> DataFrame:
    """The first rows of each stratum in drawing order, up to its quota.

    Each stratum is dealt to PARTS parts, of which none can give more than the quota; only what they leave is put in
    one order, so that a large stratum is not sorted in one task.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(*stratum, *by).orderBy(drawn(key, seed), key))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("_r", place("_part")).where(F.col("_r") <= quota)
    return dealt.withColumn("_r", place()).where(F.col("_r") <= quota).drop("_r", "_part")


def balanced_sample(rows: DataFrame, flag: str, key: str, limit: int, seed: int) -> DataFrame:
    """Half of ``limit`` rows with the flag and half without it; the odd one has it."""
    quota = F.when(F.col(flag), F.lit(limit - limit // 2)).otherwise(F.lit(limit // 2))
    return quota_sample(rows, [flag], key, quota, seed)


def batches(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """Number of the batch of ``n`` rows that each row of a group falls into, from 0."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / n).cast("long"))


def whole_groups(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """Rows of whole groups, in the order in which groups first appear, until the next one would pass ``limit``.

    The first group always stays. Only one row per group is put into one order.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    upto = Window.orderBy("_first", group).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumn("_sum", F.sum("_n").over(upto)).withColumn("_rank", F.row_number().over(Window.orderBy("_first", group)))
    kept = sizes.where((F.col("_rank") == 1) | (F.col("_sum") <= limit)).select(group)
    return rows.join(kept, group, "left_semi")


def apportioned(weights: DataFrame, group: list[str], name: str, weight: str, total: str) -> DataFrame:
    """Whole parts of each group's total by weight (largest remainders; ties by name): adds part."""
    whole = Window.partitionBy(*group)
    exact = F.col(total) * F.col(weight) / F.sum(weight).over(whole)
    rows = weights.withColumn("_low", F.floor(exact).cast("long")).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    left = F.col(total) - F.sum("_low").over(whole)
    place = F.row_number().over(whole.orderBy(F.desc("_rest"), name))
    return rows.withColumn("_left", left).withColumn("_place", place).withColumn("part", F.col("_low") + (F.col("_place") <= F.col("_left")).cast("long")).drop("_low", "_rest", "_left", "_place")
