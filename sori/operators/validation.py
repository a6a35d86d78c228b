"""Checks of answers and reports: parsing, contracts, grounding; each returns columns, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions.text import forbidden

ANSWER = "array<struct<id:bigint,aspect:string,sentiment:int>>"
#: Numbers of reports with their units, and how far they may be off.
NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s*(%p|%|건|)"
TOLERANCE, SCORE_TOLERANCE = 0.5, 0.005


def parsed_answer(text: Column) -> Column:
    """Answer of a model as an array of (id, aspect, sentiment); null if it is not of that form."""
    return F.from_json(text, ANSWER)


def labels_or_default(labels: Column, source: Column) -> Column:
    """Labels of an item: an inquiry without any is about something else, neutral; a review may have none."""
    other = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), F.lit("기타").alias("aspect"), F.lit(0).alias("sentiment")))
    return F.when((F.size(labels) == 0) & (source == "cs"), other).otherwise(labels)


def allowed_labels(labels: Column, source: Column) -> Column:
    """Labels whose attribute and sentiment exist; of reviews, only the attributes that they may be about."""
    known = lambda a: a.isin(*C.ASPECTS) & ((source != "review") | a.isin(*C.REVIEW_ASPECTS))
    return F.filter(labels, lambda x: known(x["aspect"]) & x["sentiment"].isin(-1, 0, 1))


def negative_aspects(labels: Column) -> Column:
    """Attributes of the negative labels, in their order."""
    return F.transform(F.filter(labels, lambda x: x["sentiment"] == -1), lambda x: x["aspect"])


def answer_errors(asked: Column, answered: Column) -> Column:
    """Errors of a batch answer: ids that were not asked for, ids without an answer, repeated ids, another order."""
    ids = F.transform(answered, lambda x: x["id"])
    checks = [
        ("unknown ids", F.size(F.array_except(ids, asked)) > 0),
        ("missing ids", F.size(F.array_except(asked, ids)) > 0),
        ("repeated ids", F.size(F.array_distinct(ids)) != F.size(ids)),
        ("order", ids != asked),
    ]
    return errors(checks)


def errors(checks: list[tuple[str, Column]]) -> Column:
    """Names of the checks that hit, as an array; an undecided check (null) does not hit."""
    return F.filter(F.array(*(F.when(hit, name) for name, hit in checks)), lambda e: e.isNotNull())


def numbers(text: Column) -> Column:
    """Numbers of a text with their units, as (value, unit); whole numbers without a unit are left out."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(NUMBER), 1).alias("raw"), F.regexp_extract_all(text, F.lit(NUMBER), 2).alias("unit"))
    some = F.filter(found, lambda x: (x["unit"] != "") | F.contains(x["raw"], F.lit(".")))
    return F.transform(some, lambda x: F.struct(F.regexp_replace(x["raw"], ",", "").cast("double").alias("value"), x["unit"].alias("unit")))


def ungrounded_numbers(text: Column, allowed: Column) -> Column:
    """Numbers of a text that no allowed one (value, unit) is near, in its unit."""
    tolerance = lambda u: F.when(u == "", SCORE_TOLERANCE).otherwise(TOLERANCE)
    near = lambda n: F.exists(allowed, lambda a: (a["unit"] == n["unit"]) & (F.abs(a["value"] - n["value"]) <= tolerance(n["unit"])))
    return F.filter(numbers(text), lambda n: ~near(n))


def allowed_percents(ratios: list[Column]) -> Column:
    """Ratios as percents that a text may state: exact, rounded to a tenth, and without sign."""
    values = [f(F.bround(r * 100, 4)) for r in ratios for f in (lambda p: p, lambda p: F.bround(p, 1), F.abs)]
    return F.array_distinct(F.array(*(F.struct(v.alias("value"), F.lit("%").alias("unit")) for v in values)))


def report_errors(ids_equal: Column, asked: Column, covered: Column, text: Column, allowed: Column) -> Column:
    """Errors of a report: other ids, attributes missing or made up, ungrounded numbers, forbidden expressions."""
    return errors([
        ("ids differ", ~ids_equal),
        ("attributes missing", F.size(F.array_except(asked, covered)) > 0),
        ("attributes made up", F.size(F.array_except(covered, asked)) > 0),
        ("numbers not grounded", F.size(ungrounded_numbers(text, allowed)) > 0),
        ("forbidden expressions", F.size(forbidden(text)) > 0),
    ])


def proposal_confidence(label: Column, grounded: Column, consistent: Column, similar: Column, detection: Column) -> Column:
    """Confidence of a proposal: by evidence, cause and precedent, then capped by the cause's label and the detection."""
    levels = F.array(F.lit(C.LOW), F.lit(C.MEDIUM), F.lit(C.HIGH))
    base = F.when(~grounded, 1).when(consistent | similar, 3).otherwise(2)
    by_label = F.when(label == "기타", 2).otherwise(3)
    by_detection = F.when(detection.isin(C.LOW, C.NOT_APPLICABLE), 1).when(detection == C.MEDIUM, 2).otherwise(3)
    return F.when(label.isin(*C.UNSOLVABLE), C.LOW).otherwise(F.element_at(levels, F.least(base, by_label, by_detection)))


def sentiment_of(name: Column) -> Column:
    """Sentiment of a name in any of its spellings; null if it is unknown."""
    table = F.create_map(*(F.lit(x) for kv in C.SENTIMENT_NAMES.items() for x in kv))
    return F.try_element_at(table, F.lower(F.trim(name)))
