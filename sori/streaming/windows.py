"""Sliding windows over a stream: each day's current week and the weeks before it, kept up to date as days arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori import constants as C


def sliding_counts(docs: DataFrame, by: list[str], late_days: int = 35) -> DataFrame:
    """Documents in the current week and in the four weeks before, for every day that a window may end on: by, window_end, current, past.

    ``docs`` is a stream with ``by`` and day (date). A document counts in the windows of its own and the next 34 days, in
    seven of them as current. State is two sums for each group and end, merged within each task before rows are moved;
    it is let go once the newest document is ``late_days`` further than the window's end. A document that comes late
    changes the windows that are still open; each changed window is put out again with its new sums (update mode).
    """
    whole = C.CURRENT_DAYS + C.PAST_DAYS
    ends = docs.select(*by, F.col("day").alias("_day"), F.explode(F.sequence("day", F.date_add("day", whole - 1))).alias("window_end"))
    rows = ends.withColumn("at", F.col("window_end").cast("timestamp")).withWatermark("at", f"{whole - 1 + late_days} days")  # the newest end lies so far ahead of its document
    now = F.datediff("window_end", "_day") < C.CURRENT_DAYS
    sums = rows.groupBy(*by, "at").agg(F.count_if(now).alias("current"), F.count_if(~now).alias("past"))
    return sums.select(*by, F.col("at").cast("date").alias("window_end"), "current", "past")


def keep_updates(counts: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Write each batch's changed windows below ``path``, under its number; a batch that is repeated replaces itself."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    step = lambda rows, n: rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/{n}")
    query = counts.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    if not interval:
        query.awaitTermination()
    return query


def newest_counts(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """Each window as its last update has it."""
    rows = spark.read.parquet(f"{path}/*")
    last = rows.groupBy(*by, "window_end").agg(F.max(F.struct("batch", "current", "past")).alias("last"))
    return last.select(*by, "window_end", "last.current", "last.past")
