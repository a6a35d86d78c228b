"""Joins of the audits: lookups, evidence, windows against windows, alerts against alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sori import constants as C

SLOT = ["product", "aspect", "channel", "source"]


def lookup(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row for each key: the first (or the last) in the order of a column."""
    pick = F.max_by if last else F.min_by
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*others), F.col(order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others))


def evidence(lists: DataFrame, docs: DataFrame, key: str = "alert_id") -> DataFrame:
    """Documents that each list of ids names, in its order: once each, without missing ids and blank texts.

    ``lists`` has the key and ids (array); ``docs`` has item_id, content. Adds pos, from 0, gapless.
    """
    named = lists.select(key, F.posexplode("ids").alias("_at", "item_id")).groupBy(key, "item_id").agg(F.min("_at").alias("_at"))
    found = named.join(docs.where(F.trim("content") != "").select("item_id", "content"), "item_id")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_at")) - 1
    return found.withColumn("pos", pos).drop("_at")


def alert_days(alerts: DataFrame) -> DataFrame:
    """Days that each alert's window covers: product, aspect, channel, day. Alerts of all channels are left out."""
    rows = alerts.where("channel <> 'ALL'").select("product", "aspect", "channel", F.explode(F.sequence("window_start", "window_end")).alias("day"))
    return rows.distinct()


def overlay(rows: DataFrame, cache: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the cache's value where it has one; hit says where."""
    seen = cache.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    both = rows.join(seen, key, "left").withColumn("hit", F.coalesce("_hit", F.lit(False)))
    return both.withColumn(column, F.when(F.col("hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def alert_kinds(alerts: DataFrame, truth: DataFrame, ignored: DataFrame) -> DataFrame:
    """Kind of each alert: true (in a true window), echo (the window still in view after it), ignored, or false.

    ``alerts`` has alert_id, day, channels and the slot's other columns; ``truth`` and ``ignored`` have the slot and
    start, end. The best kind over an alert's channels counts.
    """
    tail = C.CURRENT_DAYS - 1
    spans = truth.withColumn("scored", F.lit(True)).unionByName(ignored.withColumn("scored", F.lit(False)))
    rows = alerts.select("alert_id", "day", "product", "aspect", "source", F.explode_outer("channels").alias("channel"))
    inside, late = F.col("day").between(F.col("start"), F.col("end")), F.col("day").between(F.date_add("end", 1), F.date_add("end", tail))
    rank = F.when(F.col("scored") & inside, 0).when(F.col("scored") & late, 1).when(~F.col("scored") & (inside | late), 2).otherwise(3)
    best = rows.join(spans, SLOT, "left").groupBy("alert_id").agg(F.min(F.coalesce(rank, F.lit(3))).alias("_kind"))
    return best.select("alert_id", F.element_at(F.array(*map(F.lit, ("true", "echo", "ignored", "false"))), F.col("_kind") + 1).alias("kind"))


def scorecard(kinds: DataFrame) -> DataFrame:
    """One row: alerts published, those of each kind, share of false ones among the scored."""
    n = {k: F.count_if(F.col("kind") == k) for k in ("true", "echo", "ignored", "false")}
    scored = F.count_if(F.col("kind") != "ignored")
    return kinds.agg(F.count("*").alias("published"), *(c.alias(f"n_{k}") for k, c in n.items()), F.coalesce(F.try_divide(n["false"], scored), F.lit(0.0)).alias("false_ratio"))


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Days that two closed intervals have in common."""
    return F.greatest(F.lit(0), F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)) + 1)


def overlapping(alerts: DataFrame, cases: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an alert's current window (seven days up to its day) and a case's window that overlap, with the days.

    Windows are cut into weeks, and a pair meets in the first week that it shares, so that a hot key spreads.
    """
    week = lambda d: F.floor(F.unix_date(d) / C.CURRENT_DAYS)
    a = alerts.withColumn("from", F.date_sub("day", C.CURRENT_DAYS - 1)).withColumn("_week", F.explode(F.sequence(week("from"), week("day"))))
    c = cases.withColumn("_week", F.explode(F.sequence(week("start"), week("end"))))
    pairs = a.join(c, [*keys, "_week"]).where((F.col("from") <= F.col("end")) & (F.col("start") <= F.col("day")))
    pairs = pairs.where(F.col("_week") == week(F.greatest("from", "start")))
    return pairs.withColumn("overlap", overlap_days(F.col("from"), F.col("day"), F.col("start"), F.col("end"))).drop("_week", "from")


def nearest_windows(alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """The true window nearest to each alert among those of its product, aspect and source, and how it lies.

    Next to come in the alert's own channel, else next to come in any, else the latest past one of its channel (by its
    end), else the nearest of another channel (by its start), else none. Ties: earlier start, then channel.
    """
    spans = truth.select("product", "aspect", "source", F.col("channel").alias("t_channel"), "start", "end")
    rows = alerts.join(spans, ["product", "aspect", "source"], "left")
    own, ahead = F.array_contains("channels", F.col("t_channel")), F.col("day") < F.col("start")
    place = F.when(F.col("start").isNull(), 4).when(own & ahead, 0).when(ahead, 1).when(own, 2).otherwise(3)
    away = F.when(place.isin(0, 1), F.datediff("start", "day")).when(place == 2, F.abs(F.datediff("day", "end"))).otherwise(F.abs(F.datediff("day", "start")))
    best = rows.groupBy("alert_id").agg(F.min(F.struct(place.alias("place"), away.alias("away"), F.col("start"), F.col("t_channel"))).alias("n"))
    names = ("early_same_channel", "early_other_channel", "after_same_channel", "other_channel_only", "none")
    return best.select("alert_id", F.element_at(F.array(*map(F.lit, names)), F.col("n.place") + 1).alias("relation"), F.col("n.start").alias("nearest_start"), F.col("n.t_channel").alias("nearest_channel"), F.when(F.col("n.place") < 4, F.col("n.away")).alias("days_away"))


def matched_alerts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Alerts of ``left`` that have one in ``right`` of the same product, aspect and source, with a channel in common, at most a day apart."""
    near = right.select("product", "aspect", "source", F.explode("channels").alias("channel"), F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))).alias("day")).distinct()
    rows = left.select("alert_id", "product", "aspect", "source", "day", F.explode("channels").alias("channel"))
    return rows.join(near, [*SLOT, "day"], "left_semi").select("alert_id").distinct()


def differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side (left or right)."""
    x, y = (d.select(*keys).distinct().withColumn(n, F.lit(True)) for d, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, keys, "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(*keys, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))


def preferred(rows: DataFrame, key: list[str], match: str, pos: str, n: int) -> DataFrame:
    """Up to ``n`` rows for each key: the matching ones if there are any, else any, in the order of ``pos``."""
    rows = rows.withColumn("_any", F.max(match).over(Window.partitionBy(*key)))
    kept = rows.where(F.col(match) | ~F.col("_any"))
    return kept.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(pos))).where(F.col("r") <= n).drop("_any", "r")


def combined(cs: DataFrame, review: DataFrame) -> DataFrame:
    """Inquiry and review results of a product and channel: primary source, confidence, reading, signals.

    Both have product, channel, verdict, confidence. Both fired: the inquiries' confidence, one level up if their
    verdict is biased. A source that was not evaluated has a null signal.
    """
    a, b = (d.select("product", "channel", F.struct("verdict", "confidence", "fired").alias(n)) for d, n in ((cs, "cs"), (review, "rv")))
    rows = a.join(b, ["product", "channel"], "full_outer")
    x, y = F.coalesce("cs.fired", F.lit(False)), F.coalesce("rv.fired", F.lit(False))
    level = F.col("cs.confidence")
    raised = F.when(F.col("cs.verdict") != C.BIASED, level).when(level == C.LOW, C.MEDIUM).otherwise(C.HIGH)
    out = F.when(x & y, raised).when(x, level).when(y, F.col("rv.confidence"))
    reading = F.when(x & y, C.READINGS["both"]).when(x, C.READINGS["cs"]).when(y, C.READINGS["review"])
    return rows.select("product", "channel", F.when(x, "cs").when(y, "review").alias("primary_source"), out.alias("confidence"), reading.alias("reading"), F.col("cs.fired").alias("cs_signal"), F.col("rv.fired").alias("review_signal"))
