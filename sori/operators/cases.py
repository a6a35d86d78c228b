"""Planned cases: windows of their rows, days that they cover, what predictions and alerts make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sori import constants as C

WINDOW = ["product", "channel", "source", "start_day", "end_day"]


def case_windows(config: DataFrame) -> DataFrame:
    """One row for each window of ``config``, with its aspects (sorted) and whether one of its rows should fire."""
    return config.groupBy(*WINDOW).agg(F.array_sort(F.collect_set("aspect")).alias("aspects"), F.max("intended").alias("hot"))


def covered_days(windows: DataFrame, days: int = 60) -> DataFrame:
    """Days (numbers from 1) that windows and their baselines cover: product, channel, source, n."""
    span = F.sequence(F.greatest(F.lit(1), F.col("start_day") - C.PAST_DAYS), F.least(F.lit(days), F.col("end_day")))
    return windows.where(F.col("end_day") >= 1).select("product", "channel", "source", F.explode(span).alias("n")).distinct()


def hot_channels(windows: DataFrame) -> DataFrame:
    """Slots in which a case should fire; the reviews of a channel are hot if its inquiries are."""
    hot = windows.where("hot").select("product", "channel", "source")
    return hot.unionByName(hot.where("source = 'cs'").withColumn("source", F.lit("review"))).distinct()


def missing_predictions(cases: DataFrame, docs: DataFrame, needs: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each number of days in a row: documents needed to look at cases so long, and those not predicted.

    ``cases``: product, source, end (date); ``docs``: product, source, day, predicted. Documents are counted by day
    before they meet the days that cases need.
    """
    daily = docs.groupBy("product", "source", "day").agg(F.count("*").alias("n"), F.count_if(~F.col("predicted")).alias("gone"))
    wanted = cases.withColumn("need", F.explode(F.array(*map(F.lit, needs))))
    wanted = wanted.withColumn("day", F.explode(F.sequence(F.date_sub("end", F.col("need") + C.CURRENT_DAYS - 2), F.col("end"))))
    met = wanted.join(daily, ["product", "source", "day"], "left")
    return met.groupBy("need").agg(F.coalesce(F.sum("gone"), F.lit(0)).alias("missing"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def gold_verdict(flags: Column) -> Column:
    """Verdict of the channels' flags (true, false, null: not decided): null unless every channel is decided."""
    fired = F.size(F.filter(flags, lambda x: x))
    decided = (F.size(flags) == len(C.CHANNELS)) & ~F.exists(flags, lambda x: x.isNull())
    return F.when(decided, F.when(fired == 0, C.NORMAL).when(fired == F.size(flags), C.GLOBAL).otherwise(C.BIASED))


def first_per_alert(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Why an alert in no true window may have fired: the first category that a case of its product explains.

    ``alerts``: alert_id, product, aspect, source, channel, oracle (whether the right labels fire as well); ``cases``:
    product, aspect, source, channel, overlap (days that the alert's window shares with the case's baseline), future,
    scored. A case of the same attribute and source goes before one of another source, that before another attribute.
    """
    a = alerts.select("alert_id", "product", F.col("aspect").alias("_aspect"), F.col("source").alias("_source"), F.col("channel").alias("_channel"))
    met = a.join(cases, "product")
    same_aspect, same_source, near = F.col("aspect") == F.col("_aspect"), F.col("source") == F.col("_source"), F.col("overlap") > 0
    same = same_aspect & same_source & (F.col("channel") == F.col("_channel"))
    kinds = [
        (same & near & F.col("scored"), "planned_negative"),
        (same & near, "not_scored"),
        (same_aspect & ~same_source & near, "other_source"),
        (~same_aspect & near, "other_aspect"),
    ]
    rank = F.lit(None).cast("int")
    for i, (when, _) in reversed(list(enumerate(kinds))):
        rank = F.when(when, i).otherwise(rank)
    best = met.groupBy("alert_id").agg(F.min(rank).alias("_rank"), F.max(same & F.col("future")).alias("_future"))
    category = F.when(~F.col("oracle"), "classifier_only").when(F.coalesce("_future", F.lit(False)), "future_case").otherwise("unexplained")
    for i, (_, name) in enumerate(kinds):
        category = F.when(F.col("_rank") == i, name).otherwise(category)
    return alerts.join(best, "alert_id", "left").withColumn("category", category).drop("_rank", "_future")


def outcome(action: Column, evidence: Column, chosen: Column, failed: Column) -> Column:
    """Why there is no proposal (null: there is one): ``evidence`` counts all pieces, ``chosen`` those of the chosen tool."""
    closed = ~action.eqNullSafe(F.lit(C.ACTIONS["recommend"]))
    return F.when(closed, "gate_closed").when(evidence == 0, "no_evidence").when(failed, "error").when(chosen == 0, "routed_without_evidence")


def citations(texts: Column, quote: Column, n: int = 5) -> Column:
    """The first texts that are not blank and hold a quote."""
    return F.slice(F.filter(texts, lambda t: (F.trim(t) != "") & F.contains(t, quote)), 1, n)


def reviewed_text(status: Column, edited: Column, proposed: Column) -> Column:
    """What a reviewer leaves of a text: the edited one if not blank, else the proposed one; nothing if rejected."""
    return F.when(~status.eqNullSafe(F.lit("rejected")), F.coalesce(F.nullif(F.trim(edited), F.lit("")), proposed))


def grid(products: DataFrame, aspects: tuple[str, ...], config: DataFrame, default: int) -> DataFrame:
    """Every product, channel, source and attribute, with counts of ``config`` (product, channel, source, aspect, neg, total).

    A cell that config lacks has no negatives and the total of its slot, or the default total if the slot is missing, too.
    """
    explode = lambda values: F.explode(F.array(*map(F.lit, values)))
    cells = products.select("product").distinct().withColumn("channel", explode(C.CHANNELS)).withColumn("source", explode(("cs", "review"))).withColumn("aspect", explode(aspects))
    slot = ["product", "channel", "source"]
    totals = config.groupBy(*slot).agg(F.max("total").alias("_slot"))
    out = cells.join(config, [*slot, "aspect"], "left").join(totals, slot, "left")
    return out.select(*slot, "aspect", F.coalesce("neg", F.lit(0)).alias("neg"), F.coalesce("total", "_slot", F.lit(default)).alias("total"))


def channel_pairs(docs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of channels in a fixed order with the documents of both; a missing channel has none."""
    wide = docs.groupBy(*by).pivot("channel", list(C.CHANNELS)).agg(F.count(F.lit(1)))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n(a).alias("n_a"), n(b).alias("n_b")) for i, a in enumerate(C.CHANNELS) for b in C.CHANNELS[i + 1 :]]
    return wide.select(*by, F.inline(F.array(*pairs)))


def most_common(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The most frequent values of each group, ties by value: counts first, ranks over the counts."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), value))).where(F.col("rank") <= n)


def replaced_children(old: DataFrame, new: DataFrame, answered: DataFrame) -> DataFrame:
    """Label rows (item_id, aspect, sentiment, pos) after answers: those of answered items are replaced, an attribute counts once.

    Of several labels of one attribute in an answer the first (by pos) stays; an answer without labels clears the item.
    """
    others = [c for c in new.columns if c not in ("item_id", "aspect")]
    once = new.groupBy("item_id", "aspect").agg(F.min_by(F.struct(*others), "pos").alias("_row")).select("item_id", "aspect", *(F.col(f"_row.{c}").alias(c) for c in others))
    return old.join(answered.select("item_id").distinct(), "item_id", "left_anti").unionByName(once)
