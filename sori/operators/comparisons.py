"""Planned cases against what documents show: windows under several label sets, baselines before a case, a case's context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sori import constants as C

SLOT = ("product", "channel", "source")


def counted_windows(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """cur_neg, cur_total, past_neg, past_total of each case's slot: the days up to ``window_end``, and those before them.

    ``cases``: case_id, product, aspect, channel, source, window_end (date); ``docs``: product, channel, source, aspect,
    sentiment, day. Documents are counted by slot, day and attribute first; a case asks for its 35 days one by one, so
    the join is by equality and as large as the cases.
    """
    daily = docs.groupBy(*SLOT, "day", "aspect").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == -1).alias("neg"))
    whole = C.CURRENT_DAYS + C.PAST_DAYS
    days = cases.select("case_id", *SLOT, F.col("aspect").alias("wanted"), "window_end", F.explode(F.sequence(F.date_sub("window_end", whole - 1), F.col("window_end"))).alias("day"))
    rows = days.join(daily, [*SLOT, "day"])
    now, own = F.datediff("window_end", "day") < C.CURRENT_DAYS, F.col("aspect") == F.col("wanted")
    part = lambda when, n: F.sum(F.when(when, F.col(n)).otherwise(0))
    found = rows.groupBy("case_id").agg(part(now & own, "neg").alias("cur_neg"), part(now, "n").alias("cur_total"), part(~now & own, "neg").alias("past_neg"), part(~now, "n").alias("past_total"))
    return cases.select("case_id").join(found, "case_id", "left").fillna(0)


def compared_slots(cases: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """Each case's windows as planned (label config) and under every label set: case_id, label, four counts, delta.

    ``cases`` has the planned counts cur_neg, cur_total, past_neg, past_total besides what :func:`counted_windows` asks
    for. Nothing of nothing is 0.
    """
    counts = ["cur_neg", "cur_total", "past_neg", "past_total"]
    out = cases.select("case_id", F.lit("config").alias("label"), *(F.col(c).cast("long").alias(c) for c in counts))
    for label, docs in sets.items():
        out = out.unionByName(counted_windows(cases, docs).select("case_id", F.lit(label).alias("label"), *(F.col(c).cast("long").alias(c) for c in counts)))
    return out.withColumn("delta", _share("cur_neg", "cur_total") - _share("past_neg", "past_total"))


def _share(hits: str, n: str) -> Column:
    return F.coalesce(F.try_divide(F.col(hits).cast("double"), F.col(n)), F.lit(0.0))


def past_rates(cases: DataFrame, docs: DataFrame, baselines: DataFrame) -> DataFrame:
    """Negative rate before each case against what was planned, the attribute's baseline, and products without any case.

    ``cases``: case_id, product, aspect, channel, source, window_start (date), past_neg, past_total; ``baselines``:
    aspect, channel, rate. Returns case_id, observed_neg, observed_total, observed_rate, config_rate, background_neg,
    background_total, background_rate, config_vs_background (two places; null without a background), observed_matches
    (within 0.00001), config_matches (the baseline, within 0.0001).
    """
    windows = cases.select("case_id", *SLOT, "aspect", F.date_sub("window_start", 1 - C.CURRENT_DAYS).alias("window_end"))
    seen = counted_windows(windows, docs).select("case_id", F.col("past_neg").alias("observed_neg"), F.col("past_total").alias("observed_total"))
    pure = docs.join(cases.select("product").distinct(), "product", "left_anti").groupBy("channel", "source", "aspect").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == -1).alias("neg"))
    totals = pure.groupBy("channel", "source").agg(F.sum("n").alias("background_total"))
    rows = cases.join(seen, "case_id").join(totals, ["channel", "source"], "left").join(pure.select("channel", "source", "aspect", F.col("neg").alias("background_neg")), ["channel", "source", "aspect"], "left")
    rows = rows.fillna(0, ["background_total", "background_neg"]).join(baselines.select("aspect", "channel", F.col("rate").alias("baseline")), ["aspect", "channel"], "left")
    observed, config, background = _share("observed_neg", "observed_total"), _share("past_neg", "past_total"), _share("background_neg", "background_total")
    return rows.select(
        "case_id", "observed_neg", "observed_total", observed.alias("observed_rate"), config.alias("config_rate"), "background_neg", "background_total", background.alias("background_rate"),
        F.when(background > 0, F.round(config / background, 2)).alias("config_vs_background"), (F.abs(observed - config) < 0.00001).alias("observed_matches"), F.coalesce(F.abs(config - F.col("baseline")) < 0.0001, F.lit(False)).alias("config_matches"),
    )


def case_context(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """What surrounds each case: its product's documents by part (current, past), channel, source and attribute: n, negatives.

    ``cases``: case_id, product, window_end.
    """
    daily = docs.groupBy(*SLOT, "day", "aspect").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == -1).alias("neg"))
    days = cases.select("case_id", "product", "window_end", F.explode(F.sequence(F.date_sub("window_end", C.CURRENT_DAYS + C.PAST_DAYS - 1), F.col("window_end"))).alias("day"))
    part = F.when(F.datediff("window_end", "day") < C.CURRENT_DAYS, "current").otherwise("past")
    return days.join(daily, ["product", "day"]).groupBy("case_id", part.alias("part"), "channel", "source", "aspect").agg(F.sum("n").alias("n"), F.sum("neg").alias("negatives"))
