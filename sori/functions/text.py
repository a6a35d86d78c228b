"""Deterministic checks of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Expressions that reports may not hold, and the pattern of a p-value.
FORBIDDEN = ("p-value", "p값", "p 값", "FDR", "유의확률")
P_VALUE = r"p\s*[=<>≤≥]\s*0?\.\d+"


def forbidden(text: Column) -> Column:
    """Forbidden expressions in a text (any case), and the pattern if a p-value shows."""
    low = F.lower(text)
    found = [F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in FORBIDDEN]
    return F.filter(F.array(*found, F.when(low.rlike(P_VALUE), F.lit("p-value pattern"))), lambda x: x.isNotNull())


def ungrounded(numbers: Column, allowed: Column, tolerance: float) -> Column:
    """Numbers that no allowed one is within the tolerance of."""
    return F.filter(numbers, lambda n: ~F.exists(allowed, lambda a: F.abs(n - a) <= tolerance))


def label_parts_found(label: Column, text: Column) -> Column:
    """Whether half of a label's parts (split at _, rounded up) occur in a text, without spaces and case."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", ""))
    parts = F.filter(F.split(label, "_"), lambda s: s != "")
    return F.size(F.filter(parts, lambda s: F.contains(plain(text), plain(s)))) >= F.floor((F.size(parts) + 1) / 2)


def keywords(text: Column) -> Column:
    """Distinct Hangul words of two letters or more, in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[가-힣]{2,}"), F.lit(0)))


def any_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text holds one of the markers."""
    return F.coalesce(F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m)), F.lit(False))


def parsed_set(text: Column) -> Column:
    """Distinct non-blank parts of a text split at | and commas."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[|,]"), lambda s: F.trim(s)), lambda s: s != ""))


def heaviest(weights: Column) -> Column:
    """Label of the largest weight in ``label:weight,...``, the first of equal ones; parts without a number do not count."""
    parts = F.filter(F.split(weights, ","), lambda s: F.contains(s, F.lit(":")))
    rated = F.transform(parts, lambda s, i: F.struct(F.substring(s, F.instr(s, ":") + 1, F.length(s)).try_cast("double").alias("weight"), (-i).alias("at"), F.trim(F.substring_index(s, ":", 1)).alias("label")))
    return F.array_max(F.filter(rated, lambda r: r["weight"].isNotNull()))["label"]


def fingerprint(key: Column, text: Column) -> Column:
    """A number of a row's id and text, whose sums over rows tell sets of rows apart in any order."""
    digest = F.sha2(F.concat_ws("\x1f", key.cast("string"), text), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
