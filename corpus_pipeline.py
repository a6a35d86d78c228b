"""Training corpus from documents: toxic documents go, then repeated lines, then near-duplicates; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sori.llm import linededup, minhash, packing, toxicity
from sori.llm.queries import TOKENIZER, table
from sori.llm.store import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; those that are nothing but such lines are left to the next stage."""
    return linededup.drop_duplicate_lines(docs, keep_whole=True).drop("lines_removed")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8), and all others."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("MinHash near-dedup", drop_near_duplicates), ("packing", pack)]

#: Fitting a classifier and rebuilding texts are not expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each over what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
