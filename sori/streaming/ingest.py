"""Incremental ingestion with Structured Streaming: each row once, however late its file comes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, time: str = "ts", key: str = "event_id", lateness: str = "1 day") -> DataFrame:
    """Events once each, by the stream's own state: what comes later than ``lateness`` behind the newest event is dropped.

    For feeds that only move forward. :func:`drain` and the labelling worker keep late rows instead.
    """
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def unseen(rows: DataFrame, known: DataFrame, key: str, time: str) -> DataFrame:
    """Rows whose key is not among ``known`` (key, seen_on), one for each key, in whatever order they come.

    ``seen_on`` is the day of a row's time. Copies of a row have its time, so only entries of the days that occur in
    ``rows`` are read (the driver gets these days, one value each): a batch of new rows costs what its own days hold,
    and a late one what the days hold that it belongs to. A copy with another time passes; what is written by key
    replaces itself then.
    """
    days = [r[0] for r in rows.select(F.col(time).cast("date")).distinct().collect()]
    dated = [d for d in days if d is not None]
    near = known.where(F.col("seen_on").isin(dated) if len(dated) == len(days) else F.col("seen_on").isin(dated) | F.col("seen_on").isNull())
    return rows.dropDuplicates([key]).join(near.select(key), key, "left_anti")


def drain(spark: SparkSession, path: str, schema, checkpoint: str, write: Callable[[DataFrame, int], None], files_per_batch: int = 8, key: str = "event_id", time: str = "ts"):
    """Process all files that a checkpoint has not seen, in batches, and stop; ``write`` must be idempotent by batch id.

    Rows come once each, late or not: the keys of each batch are written beside the checkpoint once ``write`` is
    through, and later batches leave them out. A batch that is repeated only looks at the keys of those before it.
    """
    seen = f"{checkpoint.rstrip('/')}-seen"
    kind = spark.createDataFrame([], schema).schema[key].dataType.simpleString()
    keys = f"{key} {kind}, seen_on date, batch long"

    def step(batch: DataFrame, batch_id: int) -> None:
        earlier = [f"{seen}/{n}" for n in written(spark, seen) if n < batch_id]
        known = spark.read.schema(keys).parquet(*earlier) if earlier else spark.createDataFrame([], keys)
        rows = unseen(batch, known, key, time).persist()
        try:
            write(rows, batch_id)
            rows.select(key, F.col(time).cast("date").alias("seen_on"), F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{seen}/{batch_id}")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def written(spark: SparkSession, path: str, last: str = "") -> list[int]:
    """Numbers of the folders below ``path`` whose table (or whose table ``last``) is complete, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/{last}/_SUCCESS" if last else f"{path}/*/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    folders = (f.getPath().getParent().getParent() if last else f.getPath().getParent() for f in found)
    return sorted(int(f.getName()) for f in folders)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
