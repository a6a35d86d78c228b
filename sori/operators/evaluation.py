"""Measures of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and their harmonic mean; 0 where undefined."""
    return {"precision": _share(tp, tp + fp), "recall": _share(tp, tp + fn), "f1": _share(2 * tp, 2 * tp + fp + fn)}


def matches(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Gold and predicted labels side by side, one row for each item and attribute that either has.

    ``gold`` and ``predicted`` have the keys, aspect and sentiment. Items without any prediction are unanswered and
    take no part.
    """
    answered = predicted.select(*keys).distinct()
    g = gold.join(answered, keys, "left_semi").select(*keys, "aspect", F.col("sentiment").alias("gold"))
    p = predicted.join(gold.select(*keys).distinct(), keys, "left_semi").select(*keys, "aspect", F.col("sentiment").alias("pred"))
    return g.join(p, [*keys, "aspect"], "full_outer")


def attribute_scores(sides: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and sentiment accuracy among the found, for each group (or over all)."""
    both = F.col("gold").isNotNull() & F.col("pred").isNotNull()
    counts = sides.groupBy(*by).agg(F.count_if(both).alias("tp"), F.count_if(F.col("gold").isNull()).alias("fp"), F.count_if(F.col("pred").isNull()).alias("fn"), F.count_if(both & (F.col("gold") == F.col("pred"))).alias("right"))
    return counts.withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn")) | {"sentiment_accuracy": _share(F.col("right"), F.col("tp"))}).drop("right")


def exact_share(sides: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Share of items of which every attribute and sentiment is right and none is extra."""
    item = sides.groupBy(*dict.fromkeys([*by, *keys])).agg(F.bool_and(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))).alias("exact"))
    return item.groupBy(*by).agg(F.count("*").alias("items"), F.count_if("exact").alias("exact")).withColumn("exact_share", _share(F.col("exact"), F.col("items")))


def negative_table(items: DataFrame, by: list[str], rate: float) -> DataFrame:
    """Two-by-two table of negative items and what follows from it; what a sample cannot measure is null.

    ``items`` has gold_negative and pred_negative. ``rate`` is the share of negatives in operation: from it follows the
    precision there, and, without false positives seen, a lower bound with the false positive rate at 3 / n.
    """
    g, p = F.col("gold_negative"), F.col("pred_negative")
    t = items.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    recall, fpr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("fp", F.col("fp") + F.col("tn"))
    clean, bad = F.col("fp") + F.col("tn") > 0, F.col("tp") + F.col("fn") > 0
    operational = F.try_divide(rate * recall, rate * recall + (1 - rate) * fpr)
    lower = F.when(operational.isNotNull() & (F.col("fp") == 0) & (F.col("tp") > 0), rate * recall / (rate * recall + (1 - rate) * 3 / (F.col("fp") + F.col("tn"))))
    measures = prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return t.withColumns({"precision": F.when(clean, measures["precision"]), "recall": recall, "f1": F.when(clean & bad, measures["f1"]), "fpr": fpr, "operational_precision": operational, "operational_lower": lower})


def run_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, extremes and half the range of a measure over runs."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).withColumn("half_range", (F.col("high") - F.col("low")) / 2)


def error_kinds(items: DataFrame) -> DataFrame:
    """Kind of each item's error: right, sentiment only, attribute only, both. ``items`` has gold and predicted values of both."""
    a, s = F.col("aspect") == F.col("pred_aspect"), F.col("sentiment") == F.col("pred_sentiment")
    return items.withColumn("kind", F.when(a & s, "right").when(a, "sentiment").when(s, "aspect").otherwise("both"))


def reverse_flips(items: DataFrame, by: list[str]) -> DataFrame:
    """Items that are not negative but were called so: number, and number of different texts."""
    flips = items.where("sentiment <> -1 AND pred_sentiment = -1")
    return flips.groupBy(*by).agg(F.count("*").alias("flips"), F.countDistinct("content").alias("texts"))


def bumps(items: DataFrame, slot: list[str]) -> DataFrame:
    """What predictions add to each slot's negatives: those of items that are negative too (replaced), and of others (added)."""
    wrong = items.where((F.col("pred_sentiment") == -1) & ((F.col("sentiment") != -1) | (F.col("aspect") != F.col("pred_aspect"))))
    return wrong.groupBy(*slot, F.col("pred_aspect").alias("to_aspect")).agg(F.count_if(F.col("sentiment") != -1).alias("added"), F.count_if(F.col("sentiment") == -1).alias("replaced"))


def with_gold_sentiment(predictions: Column, gold: Column) -> Column:
    """Predictions (array of structs) with every sentiment put back to the gold one: what right sentiments alone would bring."""
    return F.transform(predictions, lambda p: p.withField("sentiment", gold))
