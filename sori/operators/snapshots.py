"""Idempotent upserts, dead letters and paging over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(snapshot: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``snapshot`` with rows of ``new`` in place of those of the same key."""
    return snapshot.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def record_failures(letters: DataFrame, failed: DataFrame) -> DataFrame:
    """Dead letters after another run: attempts grow by one, the first time stays, error and last time are the new ones.

    ``letters``: item_id, error, attempts, first_failed_at, last_failed_at; ``failed``: item_id, error, at.
    """
    both = letters.join(failed.withColumnRenamed("error", "new_error"), "item_id", "full_outer")
    return both.select(
        "item_id",
        F.coalesce("new_error", "error").alias("error"),
        (F.coalesce("attempts", F.lit(0)) + F.when(F.col("at").isNotNull(), 1).otherwise(0)).alias("attempts"),
        F.coalesce("first_failed_at", "at").alias("first_failed_at"),
        F.coalesce("at", "last_failed_at").alias("last_failed_at"),
    )


def page_after(rows: DataFrame, time: str, key: str, after: tuple, size: int) -> DataFrame:
    """The next page in the order of (time, key) after a cursor."""
    cursor = F.struct(F.lit(after[0]).cast(rows.schema[time].dataType).alias(time), F.lit(after[1]).cast(rows.schema[key].dataType).alias(key))
    return rows.where(F.struct(time, key) > cursor).orderBy(time, key).limit(size)


def quarantine(rows: DataFrame, reasons: dict[str, F.Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and those with the first reason that holds."""
    reason = F.lit(None).cast("string")
    for name, when in reversed(list(reasons.items())):
        reason = F.when(when, name).otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several rows have, with their number: none if the columns are a key."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
