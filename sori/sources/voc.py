"""The document view, and its projection of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori.constants import ASPECTS, CHANNELS


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: item_id, product, channel, source, occurred_at, day, aspect, sentiment."""
    return projected(spark.read.parquet(f"{sf_dir}/events.parquet"))


def projected(e: DataFrame) -> DataFrame:
    """Documents of a table (or batch) of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    product = F.concat(F.lit("P"), F.lpad((F.col("user_id") % 12 + 1).cast("string"), 3, "0"))
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("event_id") % 3 + 1).cast("int"))
    source = F.when(F.col("event_id") % 4 == 3, "review").otherwise("cs")
    rows = e.select(F.col("event_id").alias("item_id"), product.alias("product"), channel.alias("channel"), source.alias("source"), F.col("ts").alias("occurred_at"), F.col("ts").cast("date").alias("day"), "event_type", k.alias("k"))
    hit = (F.col("source") == "cs") & (F.col("day") >= F.lit("2024-01-24").cast("date")) & (F.col("k") % 2 == 0)
    one, two = hit & (F.col("product") == "P001") & (F.col("channel") == "COUPANG"), hit & (F.col("product") == "P002")
    index = F.when(one, 0).when(two, 1).when(F.col("source") == "review", F.col("k") % 3).otherwise(F.col("k") % 6)
    sentiment = F.when((F.col("event_type") == "error") | one | two, -1).when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)
    names = F.array(*map(F.lit, ASPECTS))
    return rows.select("item_id", "product", "channel", "source", "occurred_at", "day", F.element_at(names, index + 1).alias("aspect"), sentiment.alias("sentiment"), "k")
