"""Fill-in-middle: documents cut at line borders and rearranged for infilling, and put back (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle in an output.
SENTINELS = ("<P>", "<S>", "<M>")
#: A unit: a line with its end, or the rest of a text that has none.
UNIT = r"[^\n]*\n|[^\n]+"


def rearranged(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Cut each text into prefix, middle and suffix: doc_id, text, n, form, prefix, middle, suffix, output.

    ``n`` is the number of units (lines). Two hashes of seed and doc_id give two cuts among the n + 1 borders, two more
    decide whether (``rate`` in a hundred) and how a text is rearranged: form ``psm`` is prefix, suffix, middle behind
    their sentinels, ``spm`` (``spm`` in a hundred of these) suffix, prefix, middle. Form ``plain`` leaves a text as it
    is: an empty one, one that holds a sentinel, and what ``rate`` leaves out; its three parts are null.

    Every row is worked on by itself: no shuffle, no state. Null text: empty. Null doc_id: the hash is that of the seed
    alone. Repeated rows: each gives a row, all alike. Empty table: no rows. A very long text or one without line ends
    is taken whole. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), digest.alias("digest"))
    n = F.size("units")
    h1, h2, h3, h4 = (F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    rows = rows.select("doc_id", "text", "units", n.cast("long").alias("n"), F.pmod(h1, n + 1).cast("int").alias("c1"), F.pmod(h2, n + 1).cast("int").alias("c2"), (h3 % 100).alias("h3"), (h4 % 100).alias("h4"))
    marked = F.lit(False)
    for s in sentinels:
        marked = marked | F.contains("text", F.lit(s))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") >= rate), "plain").when(F.col("h4") < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "units", "n", form.alias("form"), F.least("c1", "c2").alias("lo"), F.greatest("c1", "c2").alias("hi"))

    def part(first: Column, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, size), ""))

    lo, hi = F.col("lo"), F.col("hi")
    rows = rows.select("doc_id", "text", "n", "form", part(F.lit(1), lo).alias("prefix"), part(lo + 1, hi - lo).alias("middle"), part(hi + 1, F.col("n").cast("int") - hi).alias("suffix"))
    p, s, m = (F.lit(x) for x in sentinels)
    psm, spm_ = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return rows.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text")))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output, by its form: each sentinel is found once, as no text that holds one is rearranged.

    No sentinel starts with what another one ends with, so none can arise where parts meet.
    """
    p, s, m = sentinels

    def after(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, -1)

    def before(x: Column, mark: str) -> Column:
        return F.substring_index(x, mark, 1)

    psm = F.concat(before(after(output, p), s), after(output, m), before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), after(output, m), before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
