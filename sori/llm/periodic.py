"""Periodic runs: stretches of words that repeat with a period, found through Lyndon roots, and texts without the repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sori.llm.suffixes import runs
from sori.llm.words import portions, words_of

#: Bytes of text whose words are searched together.
PORTION = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"
SPACES = r"[\x20\x09-\x0D]+"


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """Runs of each text's words, and the text without repeats: doc_id, n_words, runs, text.

    A run is a stretch with smallest period q (words q apart are equal) of at least ``min_length`` words and
    ``min_exponent`` (3 or more) periods that no neighbouring word extends. ``runs`` (start as word number, length,
    period) are in order of start, then period. ``text`` has the words that no run contains after its first period,
    joined by one space.

    A portion's texts are one sequence of symbols (text, word), so that no run can leave its text; words are never
    compared across texts. Every row is worked on by itself: no shuffle. Memory follows the portion or, if it is
    longer, the longest text (some 200 bytes a word and more for its tables).

    Null, empty or blank text: no words, no runs, an empty text. Null doc_id: kept. Repeated rows: each gives a row.
    Empty table: no rows. Other columns are ignored.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be at least 3")

    def run(batches):
        for batch in batches:
            for b in portions(batch, 1, PORTION):
                yield _batch(b, min_length, min_exponent)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, text string")


def _batch(b: pa.RecordBatch, min_length: int, min_exponent: int) -> pa.RecordBatch:
    words = words_of(b.column(1))
    n, owners = np.diff(words.starts), words.owners()
    symbols = np.append(owners * (len(words.distinct) + 1) + words.ids, -1)
    start, length, period = runs(symbols, min_length, min_exponent)
    covered = np.zeros(len(owners) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    kept = np.cumsum(covered)[:-1] == 0
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    own = owners[start]
    ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(n)))])
    fields = pa.StructArray.from_arrays([pa.array(start - words.starts[own]), pa.array(length), pa.array(period)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), lists, words.joined(kept)], ["doc_id", "n_words", "runs", "text"])


def strongest(found: Column) -> Column:
    """Of a text's runs in order, that with the greatest length/period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.reduce(found, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with periodic ends planted into a tenth of the texts, for measuring what is found.

    With h the CRC-32 of doc_id in decimal and g = h div 10, texts of n > 0 words with h a multiple of ten get, from
    word a = g mod n on, the words a to a + p - 1 again and again, p = 1 + (n - a) div (3 + g mod 8); the others and
    those without a doc_id stay.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", SPACES), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    a = F.pmod(F.col("g"), n).cast("int")
    rows = rows.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, a).alias("a"), (3 + F.col("g") % 8).cast("int").alias("parts"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) div parts AS INT)"))
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda k: F.get("words", F.col("a") + k % F.col("p")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Numbers and digests of the runs and texts of :func:`periodic_runs`."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
