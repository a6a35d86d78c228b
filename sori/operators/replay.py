"""Day-by-day replay of detection: published alerts leave later baselines and silence repeated ones."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sori import constants as C
from sori.operators import detection as D
from sori.operators.joins import alert_days

KEPT = "alert_id string, product string, main_aspect string, channel string, window_start date, window_end date, rate double, decision string"


def replay(docs: DataFrame, first: str, last: str, path: str) -> DataFrame:
    """Alerts of every day from ``first`` to ``last`` with their decision (publish, update or suppress).

    The days are a loop of the driver, since a day depends on what was published before it; each day's alerts (at most
    a few for each product) are written below ``path`` and read from there, so lineage does not grow and a lost
    executor costs one day at most. Documents are counted by day once; the steps read those counts.
    """
    spark, day = docs.sparkSession, date.fromisoformat(first)
    D.daily_counts(docs).write.parquet(f"{path}/days")
    daily, alerts = spark.read.parquet(f"{path}/days"), f"{path}/alerts"
    while day <= date.fromisoformat(last):
        end = day.isoformat()
        past = spark.read.schema(KEPT).parquet(alerts) if day > date.fromisoformat(first) else spark.createDataFrame([], KEPT)
        published = past.where("decision <> 'suppress'")
        gone = alert_days(published.withColumnRenamed("main_aspect", "aspect"))
        D.held_slots(D.slots_of_days(daily, end, gone)).write.parquet(f"{path}/slots/{end}")
        grid = spark.read.parquet(f"{path}/slots/{end}")
        D.tested(grid).write.parquet(f"{path}/tests/{end}")
        tests = spark.read.parquet(f"{path}/tests/{end}")
        new = D.alerts(D.candidates(D.verdicts(grid, tests), tests), end)
        rates = tests.where("fired").select("product", F.col("aspect").alias("main_aspect"), F.col("source").alias("primary_source"), "channel", (F.col("cur_neg") / F.col("cur_total")).alias("rate"))
        rates = rates.unionByName(rates.groupBy("product", "main_aspect", "primary_source").agg(F.max("rate").alias("rate")).withColumn("channel", F.lit("ALL")))
        new = new.join(rates, ["product", "main_aspect", "primary_source", "channel"], "left").withColumn("window_end", F.lit(end).cast("date"))
        new = new.withColumn("window_start", F.date_sub("window_end", C.CURRENT_DAYS - 1))
        decided = D.suppress(new, published.withColumn("resolved", F.lit(False)).select("product", "main_aspect", "channel", "window_end", "rate", "resolved"))
        decided.select("alert_id", "product", "main_aspect", "channel", "window_start", "window_end", "rate", "decision").write.mode("append").parquet(alerts)
        day += timedelta(1)
    return spark.read.schema(KEPT).parquet(alerts)
