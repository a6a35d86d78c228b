"""Daily detection: slots, tests, verdicts, alerts, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions.stats import benjamini_hochberg, fisher_greater

SLOT = ["product", "channel", "source"]


def aspects(df: DataFrame) -> DataFrame:
    """The six attributes with their order: a table of fixed size."""
    values = F.array(*(F.struct(F.lit(i).alias("aspect_no"), F.lit(a).alias("aspect")) for i, a in enumerate(C.ASPECTS)))
    return df.sparkSession.range(1).select(F.inline(values))


def daily_counts(docs: DataFrame) -> DataFrame:
    """Documents (n) and negative ones of each attribute (n0, n1, ...) per slot and day: the one pass over documents."""
    neg = F.col("sentiment") == -1
    return docs.groupBy(*SLOT, "day").agg(F.count("*").alias("n"), *(F.count_if(neg & (F.col("aspect") == a)).alias(f"n{i}") for i, a in enumerate(C.ASPECTS)))


def slots(docs: DataFrame, window_end: str, excluded: DataFrame | None = None) -> DataFrame:
    """Counts of documents and negative documents in the current window and the baseline for every slot and attribute.

    ``excluded`` (product, aspect, channel, day) takes days of earlier alerts out of an attribute's baseline.
    """
    age = F.datediff(F.lit(window_end).cast("date"), F.col("day"))
    return slots_of_days(daily_counts(docs.where(age.between(0, C.CURRENT_DAYS + C.PAST_DAYS - 1))), window_end, excluded)


def slots_of_days(daily: DataFrame, window_end: str, excluded: DataFrame | None = None) -> DataFrame:
    """:func:`slots` over :func:`daily_counts`. Excluded days meet daily counts, never documents."""
    age = F.datediff(F.lit(window_end).cast("date"), F.col("day"))
    rows = daily.where(age.between(0, C.CURRENT_DAYS + C.PAST_DAYS - 1)).withColumn("now", age < C.CURRENT_DAYS)
    if excluded is not None:
        gone = excluded.groupBy("product", "channel", "day").agg(F.collect_set("aspect").alias("gone"))  # six at most
        rows = rows.join(gone, ["product", "channel", "day"], "left")
    else:
        rows = rows.withColumn("gone", F.lit(None).cast("array<string>"))
    total = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0))
    sums = []
    for i, a in enumerate(C.ASPECTS):
        past = ~F.col("now") & ~F.coalesce(F.array_contains("gone", a), F.lit(False))
        sums += [total(F.col("now"), f"n{i}").alias(f"c{i}"), total(past, f"n{i}").alias(f"p{i}"), total(past, "n").alias(f"t{i}")]
    wide = rows.groupBy(*SLOT).agg(total(F.col("now"), "n").alias("cur_total"), total(~F.col("now"), "n").alias("unfiltered_total"), *sums)
    cells = F.array(*(F.struct(F.lit(i).alias("aspect_no"), F.lit(a).alias("aspect"), F.col(f"c{i}").alias("cur_neg"), F.col(f"p{i}").alias("past_neg"), F.col(f"t{i}").alias("past_total")) for i, a in enumerate(C.ASPECTS)))
    return wide.select(*SLOT, "cur_total", "unfiltered_total", F.inline(cells))


def held_slots(grid: DataFrame, unreliable: DataFrame | None = None) -> DataFrame:
    """Adds hold: small_sample (whole product and channel), no_baseline (the slot), unreliable (product, channel, source) or null."""
    small = F.min("cur_total").over(Window.partitionBy("product", "channel")) < C.MIN_SAMPLE
    grid = grid.withColumn("_small", small)
    if unreliable is not None:
        grid = grid.join(unreliable.distinct().withColumn("_bad", F.lit(True)), SLOT, "left")
    else:
        grid = grid.withColumn("_bad", F.lit(False))
    hold = F.when(F.col("_small"), "small_sample").when(F.coalesce("_bad", F.lit(False)), "unreliable").when(F.col("past_total") == 0, "no_baseline")
    return grid.withColumn("hold", hold).drop("_small", "_bad")


def tested(grid: DataFrame, family: tuple[str, ...] = ("product",)) -> DataFrame:
    """Tests of the slots that are not held: p_value, delta, meaningful, bh_significant, fired."""
    rows = grid.where("hold IS NULL")
    p = fisher_greater(F.col("cur_neg"), F.col("cur_total"), F.col("past_neg"), F.col("past_total"))
    delta = F.col("cur_neg") / F.col("cur_total") - F.col("past_neg") / F.col("past_total")
    rows = rows.withColumn("p_value", p).withColumn("delta", delta).withColumn("meaningful", F.col("delta") >= C.MIN_DELTA)
    rows = benjamini_hochberg(rows, list(family))
    return rows.withColumn("fired", F.col("bh_significant") & F.col("meaningful"))


def verdicts(grid: DataFrame, tests: DataFrame) -> DataFrame:
    """Verdict of each product, attribute and source from the pattern of its channels: fired and held channels, verdict."""
    held = grid.where("hold IS NOT NULL").select("product", "source", "channel", "aspect").distinct()
    any_held = held.groupBy("product", "source").agg(F.array_sort(F.collect_set("channel")).alias("holding"))
    fired = F.array_sort(F.collect_set(F.when(F.col("fired"), F.col("channel"))))
    groups = tests.groupBy("product", "aspect", "aspect_no", "source").agg(fired.alias("channels"), F.array_sort(F.collect_set("channel")).alias("testable"), F.max(F.when(F.col("fired"), F.col("delta"))).alias("top_delta"))
    rows = groups.join(any_held, ["product", "source"], "left").withColumn("held", F.array_except(F.coalesce("holding", F.array().cast("array<string>")), "testable"))
    n, all_ = F.size("channels"), F.size("testable")
    verdict = F.when(n == 0, C.NORMAL).when(all_ == 1, C.INDETERMINATE).when((n == all_) & (F.size("held") > 0), C.TENTATIVE).when(n == all_, C.GLOBAL).otherwise(C.BIASED)
    return rows.withColumn("verdict", verdict).drop("holding")


def candidates(verdict_rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Candidates for each source, product and channel (ALL for global verdicts): main attribute by largest delta, the rest as subs."""
    rows = verdict_rows.where(F.col("verdict") != C.NORMAL).select("product", "aspect", "aspect_no", "source", "verdict", F.explode("channels").alias("fired_channel"))
    rows = rows.join(tests.select("product", "aspect", "source", F.col("channel").alias("fired_channel"), "delta"), ["product", "aspect", "source", "fired_channel"])
    channel = F.when(F.col("verdict").isin(C.GLOBAL, C.TENTATIVE), "ALL").otherwise(F.col("fired_channel"))
    rows = rows.withColumn("channel", channel).groupBy("source", "product", "channel", "aspect", "aspect_no", "verdict").agg(F.max("delta").alias("delta"))
    order = Window.partitionBy("source", "product", "channel").orderBy(F.desc("delta"), "aspect_no")
    rows = rows.withColumn("r", F.row_number().over(order))
    entry = F.struct("r", "aspect")
    subs = F.transform(F.array_sort(F.collect_list(F.when(F.col("r") > 1, entry))), lambda s: s["aspect"])
    main = lambda c: F.max(F.when(F.col("r") == 1, F.col(c)))
    return rows.groupBy("source", "product", "channel").agg(main("aspect").alias("main_aspect"), main("verdict").alias("verdict"), main("delta").alias("delta"), F.concat_ws(",", subs).alias("sub_aspects"))


def confidence(verdict, consistent, matched):
    """Confidence of a detection."""
    skipped = verdict.isin(C.GLOBAL, C.TENTATIVE)
    return F.when(skipped, C.NOT_APPLICABLE).when(verdict == C.INDETERMINATE, C.MEDIUM).when(~F.coalesce(consistent, F.lit(False)), C.LOW).when(matched, C.HIGH).otherwise(C.MEDIUM)


def action(verdict, aspect, consistent):
    """Recommended action."""
    out = F.when(verdict.isin(C.GLOBAL, C.TENTATIVE), C.ACTIONS["product"]).when(verdict == C.INDETERMINATE, C.ACTIONS["undetermined"])
    for a in ("파손", "오배송", "기타"):
        out = out.when(aspect == a, C.ACTIONS[a])
    return out.when(F.coalesce(consistent, F.lit(False)), C.ACTIONS["recommend"]).otherwise(C.ACTIONS["channel"])


def alerts(cands: DataFrame, window_end: str, causes: DataFrame | None = None) -> DataFrame:
    """Alerts: inquiry and review candidates of a product and channel joined, inquiries first; id, confidence, action.

    ``causes`` (product, channel, consistent) brings the consistency of biased causes. Both sources firing raises a
    biased inquiry verdict's confidence by one level.
    """
    cs, review = (cands.where(F.col("source") == s).drop("source") for s in ("cs", "review"))
    fields = ["main_aspect", "verdict", "delta", "sub_aspects"]
    both = cs.select("product", "channel", F.struct(*fields).alias("cs")).join(review.select("product", "channel", F.struct(*fields).alias("rv")), ["product", "channel"], "full_outer")
    both = both.withColumn("main", F.coalesce("cs", "rv"))
    if causes is not None:
        both = both.join(causes, ["product", "channel"], "left")
    else:
        both = both.withColumn("consistent", F.lit(None).cast("boolean"))
    verdict, aspect = F.col("main.verdict"), F.col("main.main_aspect")
    level = confidence(verdict, F.col("consistent"), F.lit(False))
    raised = F.when(F.col("cs").isNotNull() & F.col("rv").isNotNull() & (F.col("cs.verdict") == C.BIASED), F.when(level == C.LOW, C.MEDIUM).otherwise(C.HIGH)).otherwise(level)
    code = F.create_map(*(F.lit(x) for kv in C.ASPECTS.items() for x in kv))[aspect]
    alert_id = F.concat_ws("-", F.lit("ALT"), F.date_format(F.lit(window_end).cast("date"), "yyyyMMdd"), "product", code, "channel")
    return both.select(alert_id.alias("alert_id"), "product", "channel", aspect.alias("main_aspect"), F.col("main.sub_aspects").alias("sub_aspects"), verdict.alias("verdict"), F.col("main.delta").alias("delta"), F.when(F.col("cs").isNotNull(), "cs").otherwise("review").alias("primary_source"), raised.alias("confidence"), action(verdict, aspect, F.col("consistent")).alias("action"))


def suppress(new: DataFrame, prior: DataFrame) -> DataFrame:
    """Decision on each alert against the latest unresolved prior one of its key: publish, update or suppress.

    ``prior`` has product, main_aspect, channel, window_end, rate, resolved; ``new`` has window_end and rate.
    """
    key = ["product", "main_aspect", "channel"]
    latest = prior.where("NOT resolved").groupBy(*key).agg(F.max(F.struct("window_end", "rate")).alias("last"))
    rows = new.join(latest, key, "left")
    days = F.datediff("window_end", F.col("last.window_end"))
    decision = F.when(F.col("last").isNull() | (days >= C.RENOTIFY_DAYS), "publish").when(F.col("rate") - F.col("last.rate") >= C.RENOTIFY_JUMP - 1e-9, "update").otherwise("suppress")
    return rows.withColumn("decision", decision).drop("last")


def baseline_fallback(grid: DataFrame, rate: str = "fallback_rate") -> DataFrame:
    """Baselines rebuilt from a configured rate where there is one: none at all, or half of it or more was taken out.

    Without a baseline the current volume, stretched to the baseline's days, is the number of documents. Null rates
    change nothing. Halves round to even.
    """
    assumed = F.bround(F.col("cur_total") * (C.PAST_DAYS / C.CURRENT_DAYS)).cast("long")
    none, few = F.col("past_total") == 0, F.col("past_total") * 2 <= F.col("unfiltered_total")
    total = F.when(F.col(rate).isNotNull() & none, assumed).otherwise(F.col("past_total"))
    neg = F.when(F.col(rate).isNotNull() & (none | few), F.bround(F.col(rate) * total).cast("long")).otherwise(F.col("past_neg"))
    return grid.withColumns({"past_neg": neg, "past_total": total})


def robustness(tests: DataFrame) -> DataFrame:
    """Whether each test fires with one negative document less and one more, its product's family tested anew each time.

    ``tests`` is from :func:`tested`. A family has a product's slots and attributes only (36 with three channels), so
    the join within a product is of a fixed size.
    """
    slot = ["channel", "source", "aspect"]
    probes = tests.select("product", *(F.col(c).alias(f"p_{c}") for c in slot), F.col("fired").alias("before"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"))
    rows = tests.select("product", *slot, "cur_neg", "cur_total", "past_neg", "past_total").join(probes, "product")
    own = (F.col("channel") == F.col("p_channel")) & (F.col("source") == F.col("p_source")) & (F.col("aspect") == F.col("p_aspect"))
    moved = F.least(F.greatest(F.col("cur_neg") + F.col("step"), F.lit(0)), "cur_total")
    rows = rows.withColumn("own", own).withColumn("cur_neg", F.when(F.col("own"), moved).otherwise(F.col("cur_neg"))).withColumn("hold", F.lit(None).cast("string"))
    again = tested(rows, ("product", "p_channel", "p_source", "p_aspect", "step"))
    return again.where("own").select("product", *slot, "step", "before", F.col("fired").alias("after"))
