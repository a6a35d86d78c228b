"""Whether quotes stand in their sources, and whether texts resemble the examples of a prompt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sori.functions.matching import longest_pieces, matched_characters

#: Fixed value: share of a quote that must stand in the source in one piece.
SIMILARITY = 0.8


def plain(text: Column) -> Column:
    """A text without white space and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


@F.pandas_udf(DoubleType())
def longest_match(quote: pd.Series, source: pd.Series) -> pd.Series:
    """Share of a quote that the longest piece it has in common with the source makes up; frequent characters of long sources start no piece."""

    there = ((quote.notna() & (quote != "")) & source.notna()).to_numpy(bool)
    quotes, sources = quote[there].tolist(), source[there].tolist()
    out = pd.Series([None] * len(quote), dtype="float64", index=quote.index)
    out[there] = longest_pieces(quotes, sources) / np.array([len(q) for q in quotes], float)
    return out


def with_evidence(rows: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """Adds grounded: the quote stands in the source, or nearly all of it in one piece; blank ones never do.

    Only rows without the plain quote in the plain source reach Python.
    """
    q, s = plain(F.col(quote)), plain(F.col(source))
    empty = F.coalesce((F.col(quote) == "") | (F.col(source) == "") | (q == ""), F.lit(True))
    there = F.contains(s, q)
    unclear = ~empty & ~there
    share = longest_match(F.when(unclear, q), F.when(unclear, s))
    return rows.withColumn("grounded", F.when(empty, False).when(there, True).otherwise(share >= SIMILARITY))


def leaks(texts: DataFrame, examples: list[str], threshold: float) -> DataFrame:
    """For each distinct text: similarity to the most similar example, whether it leaks, that example (null if not).

    ``examples`` are those of one prompt: a handful, compared with every text. For many there is :func:`leaked_from`.
    """

    def run(frames):
        for f in frames:
            best, which = np.zeros(len(f)), np.full(len(f), None, object)
            for e in examples:
                sizes = f["text"].str.len().to_numpy() + len(e)
                ratio = np.where(sizes > 0, 2 * matched_characters(f["text"].tolist(), [e] * len(f)) / np.maximum(sizes, 1), 1.0)
                which[ratio > best] = e
                best = np.maximum(best, ratio)
            leaked = best >= threshold
            yield pd.DataFrame({"text": f["text"], "similarity": best.round(4), "leaked": leaked, "example": np.where(leaked, which, None)})

    return texts.select("text").where("text IS NOT NULL").distinct().mapInPandas(run, "text string, similarity double, leaked boolean, example string")


#: Classes that characters are counted in, for an upper bound of what two texts have in common.
CLASSES = 64


def leaked_from(texts: DataFrame, examples: DataFrame, threshold: float) -> DataFrame:
    """Texts that resemble an example: text, example_id, similarity of the most similar one, ties to the smaller id.

    ``texts`` has text, ``examples`` example_id and text: any number of each. Two texts of a similarity of ``threshold``
    differ in length by a factor of (2 - threshold) / threshold at most, so a text meets the examples of its own class
    of length and of those beside it; of these, pairs whose characters (counted in CLASSES classes) can't suffice go
    before anything is aligned. Matching blocks are searched for the rest only, for a batch of pairs at once. Empty
    texts and examples resemble nothing; null ones are left out.
    """
    factor = (2 - threshold) / threshold
    level = F.floor(F.log(F.length("text")) / float(np.log(factor))).cast("int") if factor > 1 else F.length("text")
    letters = F.transform(F.split("text", ""), lambda c: F.pmod(F.ascii(c), F.lit(CLASSES)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.size(F.filter(letters, lambda c: c == k)))
    one = texts.select("text").where("text <> ''").distinct().withColumns({"counts": counts, "level": level})
    near = F.array(*(F.col("level") + d for d in (-1, 0, 1))) if factor > 1 else F.array("level")
    one = one.withColumn("level", F.explode(near))
    other = examples.where("text <> ''").select("example_id", F.col("text").alias("example"), counts.alias("others"), level.alias("level"))
    total = F.length("text") + F.length("example")
    common = F.aggregate(F.zip_with("counts", "others", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v)
    short = F.least(F.length("text"), F.length("example"))
    pairs = one.join(other, "level").where((2 * short >= threshold * total) & (2 * common >= threshold * total)).select("text", "example_id", "example")

    def run(frames):
        for f in frames:
            sizes = f["text"].str.len() + f["example"].str.len()
            ratio = 2 * matched_characters(f["text"].tolist(), f["example"].tolist()) / sizes.to_numpy()
            f = f.assign(similarity=ratio)[ratio >= threshold]
            yield f[["text", "example_id", "similarity"]]

    kind = examples.schema["example_id"].dataType.simpleString()
    found = pairs.mapInPandas(run, f"text string, example_id {kind}, similarity double")
    best = found.groupBy("text").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "example_id")).alias("b"))
    return best.select("text", "b.example_id", F.round(-F.col("b.s"), 4).alias("similarity"))


def without_leaks(rows: DataFrame, examples: list[str], threshold: float) -> DataFrame:
    """Adds leaked and similarity to all rows by their text (false and 0 for null)."""
    found = leaks(rows, examples, threshold).select("text", "similarity", "leaked")
    return rows.join(found, "text", "left").withColumns({"similarity": F.coalesce("similarity", F.lit(0.0)), "leaked": F.coalesce("leaked", F.lit(False))})


def examples_of(prompt: str) -> list[str]:
    """Examples that a prompt quotes."""
    import re

    return re.findall(r'입력: "(.+?)"', prompt)
