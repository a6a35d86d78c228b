"""Conditions that hold for several days on end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all days between each key's first and last; days without a row have nulls."""
    ends = rows.groupBy(*keys).agg(F.min("day").alias("_low"), F.max("day").alias("_high"))
    days = ends.select(*keys, F.explode(F.sequence("_low", "_high")).alias("day"))
    return days.join(rows, [*keys, "day"], "left")


def persistence(rows: DataFrame, keys: list[str], hit: Column, days: int) -> DataFrame:
    """Dense days with persistent: ``hit`` held on each of the last ``days`` calendar days; a day without a row did not hit."""
    last = Window.partitionBy(*keys).orderBy("day").rowsBetween(1 - days, 0)
    return spine(rows, keys).withColumn("persistent", F.sum(hit.cast("int")).over(last) == days)
