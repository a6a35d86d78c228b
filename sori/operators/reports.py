"""Rules of alerts, proposals, reports and feedback, as column expressions and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import text as T
from sori.operators.detection import action

#: Label of a cause that is not settled, stage names in reports, and what stands where there is no evidence.
UNSPECIFIED = "미특정"
STAGES = {"SAFE": "안정 단계", "CAUTION": "주의 단계", "CRISIS": "위험 단계"}
NO_DETAIL = "정보 없음"
#: Words of texts that tell a customer what to do, kinds of feedback, range of ratings.
ACTIONABLE = ("하세요", "해보세요", "바랍니다", "권장", "검토", "확인", "진행", "추가")
FEEDBACK, RATINGS = ("POSITIVE", "NEGATIVE", "NEUTRAL"), (1, 5)


def stats_channel(fired: DataFrame) -> DataFrame:
    """The channel whose numbers stand for a product, attribute and source: the largest delta, of equal ones the first by name.

    ``fired`` has product, aspect, source, channel, delta.
    """
    best = F.min(F.struct((-F.col("delta")).alias("d"), "channel"))
    return fired.groupBy("product", "aspect", "source").agg(best.alias("b"), F.max("delta").alias("delta")).select("product", "aspect", "source", F.col("b.channel").alias("stats_channel"), "delta")


def sub_actions(subs: Column, verdict_of: Column) -> Column:
    """Actions for the attributes beside the main one; their causes are not known. ``verdict_of`` maps attributes to verdicts."""
    return F.transform(subs, lambda a: F.struct(a.alias("aspect"), action(verdict_of[a], a, F.lit(None).cast("boolean")).alias("action")))


def root_cause(diagnosis: Column) -> Column:
    """Null if nothing was diagnosed; else the label (none settled: UNSPECIFIED), count, total, consistent."""
    label = F.when(diagnosis["consistent"], diagnosis["label"]).otherwise(UNSPECIFIED)
    return F.when(diagnosis.isNotNull(), F.struct(label.alias("label"), diagnosis["count"].alias("count"), diagnosis["total"].alias("total"), diagnosis["consistent"].alias("consistent")))


def cause_totals(items: DataFrame, results: DataFrame, by: list[str]) -> DataFrame:
    """Diagnosed cause of each group: label (null if not consistent), count, total, invalid.

    ``items``: the group and cs_id; ``results``: cs_id, cause, aspect_match, invalid (an answer that fits no item's
    form). Answers about another attribute leave the total, invalid ones count in it. Equal counts: the smaller cause.
    """
    rows = items.join(results, "cs_id").where(F.coalesce("aspect_match", F.lit(True)) | F.coalesce("invalid", F.lit(False)))
    rows = rows.withColumn("cause", F.when(~F.coalesce("invalid", F.lit(False)), F.col("cause")))
    n = rows.groupBy(*by, "cause").agg(F.count("*").alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("cause").isNull(), F.col("n"))), F.lit(0)).alias("invalid"), F.max(F.when(F.col("cause").isNotNull(), F.col("n"))).alias("most"))
    first = n.where("cause IS NOT NULL").join(total, by).where("n = most").groupBy(*by).agg(F.min("cause").alias("cause"))
    out = total.join(first, by, "left")
    consistent = F.coalesce((F.col("most") / F.col("total") >= C.CONSISTENT_RATIO) & (F.col("most") >= C.CONSISTENT_COUNT), F.lit(False))
    return out.select(*by, F.when(consistent, F.col("cause")).alias("label"), F.when(consistent, F.col("most")).otherwise(0).alias("count"), "total", "invalid", consistent.alias("consistent"))


def cause_ids(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items that a diagnosis counts, in their input order (a row for each; ``items`` has position)."""
    counted = results.where(F.coalesce("aspect_match", F.lit(True)) | F.coalesce("invalid", F.lit(False))).select("cs_id")
    return items.join(counted, "cs_id", "left_semi")


def evaluated(grounded: Column, consistent: Column, actionable: Column, evidence: Column) -> Column:
    """Outcome of a proposal's three checks: passed, and the reasons of those that failed. Without evidence it is never grounded."""
    none = F.coalesce(evidence == NO_DETAIL, F.lit(True))
    ok = ~none & grounded
    reasons = F.concat_ws("; ", F.when(none, "no evidence").when(~ok, "not grounded"), F.when(~consistent, "inconsistent"), F.when(~actionable, "not actionable"))
    return F.struct((ok & consistent & actionable).alias("passed"), ok.alias("grounding"), reasons.alias("reasons"))


def actionable(text: Column) -> Column:
    return T.any_marker(text, ACTIONABLE)


def stage_label(severity: Column) -> Column:
    """Stage of a report's worst pair; SAFE where all pairs are held."""
    names = F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv))
    return F.element_at(names, F.coalesce(severity, F.lit("SAFE")))


def stage_errors(severity: Column, title: Column) -> Column:
    """A title must hold its stage's label and no other one; a report without a stage is not checked."""
    wanted = stage_label(severity)
    missing = F.when(~F.contains(title, wanted), F.concat(F.lit("missing "), wanted))
    others = [F.when((severity != k) & F.contains(title, F.lit(v)), F.lit(f"other {v}")) for k, v in STAGES.items()]
    return F.when(severity.isNotNull(), F.concat_ws("; ", missing, *others)).otherwise("")


#: How a list that is folded ends, what replaces a cut name's end, what stands for a held pair.
FOLDED, COUNTED, CUT, HELD = " 외 %d개", "%d개", "…", "보류"


def shortened(label: Column, room: Column) -> Column:
    """A label within ``room`` characters: a code in brackets at its end is kept and the name before it cut, if both find room."""
    code = F.when(label.endswith(")"), F.regexp_extract(label, r"(\([^(]*)$", 1)).otherwise("")
    keep = room - F.length(code) - 1
    coded = F.concat(F.substring(label, F.lit(1), keep), F.lit(CUT), code)
    plain = F.concat(F.substring(label, F.lit(1), room - 1), F.lit(CUT))
    return F.when(F.length(label) <= room, label).when(room <= 1, F.substring(label, F.lit(1), room)).when((code != "") & (keep >= 1), coded).otherwise(plain)


def notice(labels: Column, budget: int) -> Column:
    """Labels joined by commas in at most ``budget`` characters: those that fit, in order, and how many are left out.

    The tail's room is taken off first, for the largest number it can name. At least one label is shown, shortened if
    need be; without room for that, only the number of labels. Nothing, or no budget: an empty text.
    """
    n = F.size(labels)
    whole = F.array_join(labels, ", ")
    room = F.lit(budget) - F.length(F.format_string(FOLDED, n))
    first = shortened(F.get(labels, F.lit(0)), room)
    start = F.struct(F.length(first).alias("used"), F.lit(1).alias("shown"))
    rest = F.slice(labels, F.lit(2), F.greatest(n - 1, F.lit(0)))
    # what a label takes counts for those after it even if it does not fit, so nothing is shown behind a gap
    ends = F.aggregate(rest, start, lambda s, x: F.struct((s["used"] + F.length(x) + 2).alias("used"), (s["shown"] + (s["used"] + F.length(x) + 2 <= room).cast("int")).alias("shown")))
    shown = ends["shown"]
    listed = F.array_join(F.concat(F.array(first), F.slice(labels, F.lit(2), shown - 1)), ", ")
    folded = F.concat(listed, F.when(n > shown, F.format_string(FOLDED, n - shown)).otherwise(""))
    number = F.substring(F.format_string(COUNTED, n), 1, budget)
    return F.when((n <= 0) | F.lit(budget <= 0), "").when(F.length(whole) <= budget, whole).when(room < 1, number).otherwise(folded)


def number_text(value: Column) -> Column:
    """A number with at most six significant digits and no zeros at the end of its decimals (20.0 is 20); plain from 0.0001 to 999999."""
    size = F.abs(value)
    digits = F.lit(9)
    for k, d in ((0.001, 8), (0.01, 7), (0.1, 6), (1, 5), (10, 4), (100, 3), (1000, 2), (10000, 1), (100000, 0)):
        digits = F.when(size >= k, F.lit(d)).otherwise(digits)
    rounded = F.lit(None).cast("string")
    for d in range(10):
        rounded = F.when(digits == d, F.round(value, d).cast("decimal(38,9)").cast("string")).otherwise(rounded)
    return F.regexp_replace(rounded, r"\.?0+$", "")


def aspect_table(rows: DataFrame, order: dict) -> DataFrame:
    """Each product's table of attributes for a prompt: name, total, three shares in percent, drift with its sign, status.

    ``rows``: product, aspect, total, pos, neu, neg (shares from 0 to 1), drift, status (null if there is none: "-").
    Lines are in ``order`` (attribute: place). At most as many lines as there are attributes.
    """
    place = F.create_map(*(F.lit(x) for k in order.items() for x in k))[F.col("aspect")]
    sign = F.when(F.col("drift") >= 0, "+").otherwise("")
    drift = F.coalesce(F.concat(sign, number_text(F.col("drift") * 100)), F.lit("-"))
    line = F.concat_ws("|", "aspect", F.col("total").cast("string"), *(number_text(F.col(c) * 100) for c in ("pos", "neu", "neg")), drift, F.coalesce("status", F.lit("-")))
    lines = F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line"))))
    return rows.groupBy("product").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("aspect_table"))


def pair_table(rows: DataFrame) -> DataFrame:
    """Each product's table of pairs of channels: names, sample, divergence to two places, severity; a held pair has neither.

    ``rows``: product, channel_a, channel_b, sample, jsd, severity, hold_reason.
    """
    held = F.col("hold_reason").isNotNull()
    pair = F.concat_ws("-", "channel_a", "channel_b")
    line = F.concat_ws("|", pair, F.col("sample").cast("string"), F.when(held, "-").otherwise(number_text(F.round("jsd", 2))), F.when(held, HELD).otherwise(F.col("severity")))
    lines = F.array_sort(F.collect_list(F.struct(pair.alias("pair"), line.alias("line"))))
    return rows.groupBy("product").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("pair_table"))


def table_cell(text: Column) -> Column:
    """A text that breaks no table of pipes."""
    return F.trim(F.replace(F.replace(text, F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" ")))


def body(prompt: Column, header: str = "## System Prompt") -> Column:
    """A prompt after its header line; the whole text if it has none."""
    found = F.regexp_extract(prompt, rf"(?s){header}\s*\n(.*)", 1)
    return F.when(prompt.rlike(rf"(?s){header}\s*\n"), F.trim(found, F.lit(" \n\t\r"))).otherwise(prompt)


def summary_sentence(label: Column, count: Column, total: Column) -> Column:
    return F.when(label.isNull(), NO_DETAIL).otherwise(F.format_string("CS %d건 중 %d건이 '%s' 관련 언급", total, count, label))


def quote_list(texts: Column, n: int = 5) -> Column:
    """The first ``n`` texts that are not blank, as a list; NO_DETAIL if there is none."""
    some = F.slice(F.filter(texts, lambda t: F.trim(t) != ""), 1, n)
    return F.when(F.size(some) > 0, F.concat_ws("\n", F.transform(some, lambda t: F.concat(F.lit("- "), F.trim(t))))).otherwise(NO_DETAIL)


#: Why an alert matches no planned case.
EXCLUDED, NO_CASE, EARLY, LATE, OTHER = "scoring_excluded_window", "no_golden_case_same_product_aspect_source", "early_same_case", "late_same_case", "same_product_aspect_source_but_other_channel"


def false_reasons(alerts: DataFrame, windows: DataFrame, ignored: DataFrame) -> DataFrame:
    """Why an alert matches no planned case: excluded window, no case, early or late for its own, another channel.

    ``alerts``: alert_id, product, aspect, source, channel, day and, if there is one, channels: the significant ones,
    which stand for the alert's own (an alert of all channels has only these); ``windows`` and ``ignored``: the key with
    one channel, start, end, and in ``windows`` place, the order of cases (else by start). Cases of a key are few. The
    first case on one of the alert's channels that its day lies outside of decides between early and late.
    """
    key = ["product", "aspect", "source"]
    channels = F.array("channel")
    if "channels" in alerts.columns:
        channels = F.when(F.size("channels") > 0, F.col("channels")).otherwise(channels)
    alerts = alerts.withColumn("channels", channels)
    each = alerts.select("alert_id", *key, "day", F.explode("channels").alias("channel"))
    spans = ignored.select(*key, "channel", F.col("start").alias("_s"), F.col("end").alias("_e"))
    excluded = each.join(spans, [*key, "channel"]).where((F.col("day") >= F.col("_s")) & (F.col("day") <= F.col("_e") + 6)).select("alert_id").distinct().withColumn("excluded", F.lit(True))
    place = F.col("place") if "place" in windows.columns else F.col("start")
    cases = windows.select(*key, F.col("channel").alias("case_channel"), "start", "end", place.alias("place"))
    joined = alerts.join(cases, key, "left")
    early = F.col("day") < F.col("start")
    outside = F.array_contains("channels", F.col("case_channel")) & (early | (F.col("day") > F.col("end")))
    facts = joined.groupBy("alert_id").agg(F.count("case_channel").alias("cases"), F.min(F.when(outside, F.struct("place", "start", early.alias("early")))).alias("first"))
    rows = facts.join(excluded, "alert_id", "left")
    reason = F.when(F.col("excluded"), EXCLUDED).when(F.col("cases") == 0, NO_CASE).when(F.col("first.early"), EARLY).when(F.col("first").isNotNull(), LATE).otherwise(OTHER)
    return rows.select("alert_id", reason.alias("reason"))


def feedback_checks(rows: DataFrame) -> DataFrame:
    """Feedback with aside (an id is missing: recorded nowhere) and warnings (unknown kind, rating out of range: recorded)."""
    kind = F.col("kind").isNotNull() & ~F.col("kind").isin(*FEEDBACK)
    rating = F.col("rating").isNotNull() & ~F.col("rating").between(*RATINGS)
    return rows.withColumns({"aside": F.col("feedback_id").isNull() | F.col("report_id").isNull(), "warnings": F.concat_ws(",", F.when(kind, "kind"), F.when(rating, "rating"))})


def merged_review(recommendation: Column, status: Column, feedback: Column) -> Column:
    """A recommendation as it was published, with the review's status and feedback in place of its own."""
    return recommendation.withField("hitl_status", status).withField("hitl_feedback", feedback)


def local_or_as_is(text: Column) -> Column:
    """A time with an offset in local time; one without stays as it is, as nobody knows its zone."""
    aware = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    utc = F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())
    local = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), utc.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(aware, F.concat(local, F.lit("+09:00"))).otherwise(text)


def eta(done: Column, total: Column, seconds: Column) -> Column:
    """Seconds that the rest will take at the speed so far; 0 before the first."""
    return F.when(done > 0, seconds / done * (total - done)).otherwise(0.0)


def late(done: Column, total: Column, seconds: Column, left: Column) -> Column:
    return eta(done, total, seconds) > left


def cases_scored(gold: DataFrame, predicted: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: counts of cases found, missed, falsely raised and rightly quiet, and of what else is right.

    ``gold``: case_id, source, product, channel, verdict, is_biased (null if not claimed), main_aspect, confidence (null
    if not claimed), root_cause, channel_significant, scoring_included; a row for each channel, of which the first by
    channel counts for the case. Rows that are not included count nowhere. ``predicted``: product, source, channel,
    verdict, main_aspect, confidence; the first by channel stands for a case, none means normal. ``tests``: product,
    aspect, channel, source, fired.

    Bias and confidence are scored where gold claims them, the attribute only for anomalies. ``cause_skipped`` counts
    anomalies within the scope of causes to which gold gives none. For biased cases each channel counts: whether it is
    significant in gold and whether the predicted attribute's test fired there.
    """
    gold = gold.where("scoring_included")
    first = Window.partitionBy("case_id", "source").orderBy("channel")
    g = gold.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    best = (F.min_by(c, "channel").alias(f"p_{c}") for c in ("verdict", "main_aspect", "confidence"))
    p = predicted.groupBy("product", "source").agg(*best)
    rows = g.join(p, ["product", "source"], "left").withColumn("p_verdict", F.coalesce("p_verdict", F.lit(C.NORMAL)))
    bad, raised = F.col("verdict") != C.NORMAL, F.col("p_verdict") != C.NORMAL
    claims, sure = F.col("is_biased").isNotNull(), F.col("confidence").isNotNull()
    cases = rows.agg(
        F.count_if(bad & raised).alias("found"), F.count_if(bad & ~raised).alias("missed"), F.count_if(~bad & raised).alias("false"), F.count_if(~bad & ~raised).alias("quiet"),
        F.count_if(F.col("verdict") == F.col("p_verdict")).alias("verdicts"), F.count_if(bad & F.col("main_aspect").eqNullSafe(F.col("p_main_aspect"))).alias("aspects"),
        F.count_if(claims).alias("bias_claimed"), F.count_if(claims & (F.col("is_biased") == (F.col("p_verdict") == C.BIASED))).alias("bias_right"),
        F.count_if(sure).alias("confidence_claimed"), F.count_if(sure & (F.col("confidence") == F.col("p_confidence"))).alias("confidence_right"),
        F.count_if(bad & F.col("root_cause").isNull() & F.col("main_aspect").isin(*C.SCOPE)).alias("cause_skipped"),
    )
    biased = gold.where(F.col("verdict") == C.BIASED).select("product", "source", "channel", "channel_significant").join(p.select("product", "source", F.col("p_main_aspect").alias("aspect")), ["product", "source"], "left")
    biased = biased.join(tests.select("product", "aspect", "channel", "source", "fired"), ["product", "aspect", "channel", "source"], "left")
    right = F.coalesce("channel_significant", F.lit(False)) == F.coalesce("fired", F.lit(False))
    channels = biased.agg(F.count("*").alias("channels"), F.count_if(right).alias("channels_right"))
    return cases.join(F.broadcast(channels), how="cross")  # one row and one row


def negative_scope(rows: DataFrame) -> DataFrame:
    """Among items that gold calls negative: hits, misses and extra attributes; and the share of items with several.

    ``rows``: gold_negative, gold_aspect, predicted (array of attributes).
    """
    neg = F.col("gold_negative")
    hit = F.array_contains("predicted", F.col("gold_aspect"))
    extra = F.size(F.filter(F.array_distinct("predicted"), lambda a: a != F.col("gold_aspect")))
    tp, fp = F.count_if(neg & hit), F.coalesce(F.sum(F.when(neg, extra)), F.lit(0))
    out = rows.agg(tp.alias("tp"), F.count_if(neg & ~hit).alias("fn"), fp.cast("long").alias("fp"), F.count_if(F.size("predicted") > 1).alias("several"), F.count("*").alias("n"))
    return out.withColumns({"accuracy": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "several_rate": F.coalesce(F.try_divide("several", "n"), F.lit(0.0))})


def sensitivity(rows: DataFrame) -> DataFrame:
    """Of mutated outputs how many a validator catches, of clean ones how many it passes. ``rows``: mutated, errors (array)."""
    caught = F.size("errors") > 0
    return rows.agg(F.count_if("mutated").alias("mutated"), F.count_if(F.col("mutated") & caught).alias("caught"), F.count_if(~F.col("mutated")).alias("clean"), F.count_if(~F.col("mutated") & ~caught).alias("passed"))


def day_scores(alerts: DataFrame, windows: DataFrame) -> DataFrame:
    """For each case whether an alert falls on its last day, and alerts inside and outside the case's window.

    ``alerts``: product, aspect, day; ``windows``: case_id, product, aspect, start, end.
    """
    rows = windows.join(alerts, ["product", "aspect"], "left")
    inside = F.col("day").between(F.col("start"), F.col("end"))
    out = rows.groupBy("case_id").agg(F.count_if(F.col("day") == F.col("end")).alias("_last"), F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))
    return out.select("case_id", (F.col("_last") > 0).alias("at_end"), "inside", "outside")


def relabelled(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with new labels where the text that was judged is still the same; drifted ones keep theirs and are marked.

    ``rows``: item_id, text, label; ``decisions``: item_id, text_sha (of the judged text), new_label.
    """
    both = rows.join(decisions, "item_id", "left")
    same = F.sha2("text", 256) == F.col("text_sha")
    return both.select("item_id", F.when(same & F.col("new_label").isNotNull(), F.col("new_label")).otherwise(F.col("label")).alias("label"), F.coalesce(~same, F.lit(False)).alias("drifted"))
