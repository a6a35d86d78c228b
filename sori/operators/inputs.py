"""Inputs of a detection run: documents, their labels, and what was dropped on the way."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import predicates as P
from sori.functions.times import local_time

#: Reasons why rows are dropped.
UNMAPPED, MALFORMED, MISMATCH = "상품매핑 없음", "채널·소스·시각 형식 오류", "분류 결과 스키마 불일치"
DAYS = C.CURRENT_DAYS + C.PAST_DAYS


def unified(cs: DataFrame, reviews: DataFrame) -> DataFrame:
    """One view of inquiries and reviews, under common names. Each has its own time column."""
    fields = ["item_id", "channel", "product", "content"]
    a = cs.select(*fields, F.lit("cs").alias("source"), F.col("inquired_at").alias("occurred_at"))
    return a.unionByName(reviews.select(*fields, F.lit("review").alias("source"), F.col("created_at").alias("occurred_at")))


def aspect_rows(parents: DataFrame, docs: DataFrame, children: DataFrame, active) -> DataFrame:
    """Labels of the documents that the active labeller has done: item_id, aspect, sentiment, null for one without labels."""
    done = parents.join(docs.select("item_id", "source"), "item_id").where(active)
    return done.select("item_id").join(children.select("item_id", "aspect", "sentiment"), "item_id", "left")


def batch_inputs(docs: DataFrame, aspects: DataFrame, window_end: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, documents and counts of dropped rows by reason.

    ``docs``: item_id, product, channel, source, occurred_at (text, UTC), content. ``aspects``: see :func:`aspect_rows`.
    Documents without a product, or with an unknown channel or source or an unreadable time, leave both sides; the
    window is cut by local days. An item whose labels no review (or inquiry) may have leaves the items only, so that
    coverage shows it. Labels of an item are few, so that a list of them is bounded.
    """
    at = F.try_to_timestamp("occurred_at").cast("timestamp_ntz")
    rows = docs.withColumns({"product": F.trim(F.coalesce("product", F.lit(""))), "at": at})
    known = F.coalesce(F.col("channel").isin(*C.CHANNELS) & F.col("source").isin("cs", "review") & F.col("at").isNotNull(), F.lit(False))
    rows = rows.withColumn("reason", F.when(F.col("product") == "", UNMAPPED).when(~known, MALFORMED))
    kept = rows.where(F.col("reason").isNull() & P.in_window(F.col("at"), window_end, DAYS))
    documents = kept.select("item_id", "product", "channel", "source", local_time(F.col("at")).cast("date").alias("day"), F.col("content").alias("text"))
    label = F.when(F.col("aspect").isNotNull(), F.struct("aspect", "sentiment"))
    nested = aspects.groupBy("item_id").agg(F.collect_list(label).alias("labels"))
    nested = nested.join(documents.select("item_id", "product", "channel", "source", "day"), "item_id")
    allowed = F.when(F.col("source") == "review", F.array(*map(F.lit, C.REVIEW_ASPECTS))).otherwise(F.array(*map(F.lit, C.ASPECTS)))
    fits = F.forall("labels", lambda x: F.array_contains(allowed, x["aspect"]) & x["sentiment"].isin(-1, 0, 1))
    dropped = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    wrong = nested.where(~fits).groupBy(F.lit(MISMATCH).alias("reason")).agg(F.count("*").alias("n"))
    return nested.where(fits), documents, dropped.unionByName(wrong)


def ordered_texts(docs: DataFrame, slot: list[str], negative) -> DataFrame:
    """Texts of each slot's negative documents with their place in the order of time and id.

    One row for each text instead of a list, as a slot may have any number; places are counted within a day, on top of
    the days before, so that no task orders more than a slot's day.
    """
    rows = docs.where(negative).withColumn("_day", F.col("occurred_at").cast("date"))
    days = rows.groupBy(*slot, "_day").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*slot).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(*slot, "_day", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*slot, "_day").orderBy("occurred_at", "item_id"))
    return rows.withColumn("place", place).join(days, [*slot, "_day"]).withColumn("place", F.col("place") + F.col("_before")).drop("_day", "_before")


def window_of(days: DataFrame, window_end: str | None = None) -> DataFrame:
    """Bounds of the current window and the baseline, from ``window_end`` or the latest day: one row."""
    last = F.max("day") if window_end is None else F.max(F.lit(window_end).cast("date"))
    row = days.agg(last.alias("window_end"))
    start = F.date_sub("window_end", C.CURRENT_DAYS - 1)
    return row.select(start.alias("window_start"), "window_end", F.date_sub(start, C.PAST_DAYS).alias("past_start"), F.date_sub(start, 1).alias("past_end"))


def linked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of the listed ids: each once, ids without a document left out. Short lists are broadcast by the optimiser."""
    return docs.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def fetched(rows: DataFrame, where: dict[str, str], include: list[str], limit: int) -> DataFrame:
    """Rows of exact metadata values, only the asked columns, the first ``limit`` by id."""
    for name, value in where.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy("id").limit(limit).select("id", *include)


def scoped_upsert(stored: DataFrame, new: DataFrame, tenant: str) -> DataFrame:
    """Documents of a vector store after new ones, whose ids are scoped by tenant so that the same run gives the same ids."""
    new = new.withColumn("id", F.concat_ws(":", F.lit(tenant), F.col("id").cast("string")))
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new)


def golden(docs: DataFrame, variants: DataFrame, mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their group, over the catalog and the golden mapping, and their gold labels; unmapped ones are left out.

    ``docs``: item_id, channel, channel_product_id. A channel's product may have several variants: the last by id counts.
    """
    groups = variants.join(mapping, "variant").groupBy("channel", "channel_product_id").agg(F.max_by("grp", "variant").alias("grp"))
    return docs.join(groups, ["channel", "channel_product_id"]).join(labels.dropDuplicates(["item_id"]), "item_id", "left")


def columns_missing(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Columns that a table of an older layout lacks or has under another type: empty if it is current."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return sorted(n for n, t in wanted.items() if have.get(n) != t)


def layouts(tables: dict[str, DataFrame], wanted: dict[str, str], key: list[str]) -> DataFrame:
    """What stands against reading each table as one of the current layout: name, missing, rows, repeated, ok.

    ``missing`` are columns that are absent or of another type; ``repeated`` the rows beyond one for each key, for
    tables from before the key was unique (null where a key column is absent). Tables are read once each.
    """
    out = None
    for name, df in tables.items():
        absent = [c for c in key if c not in df.columns]
        if absent:
            counts = df.agg(F.count("*").alias("rows"), F.lit(None).cast("long").alias("repeated"))
        else:
            keys = df.groupBy(*key).agg(F.count("*").alias("n"))
            counts = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
        missing = ",".join(columns_missing(df, wanted))
        rows = counts.select(F.lit(name).alias("name"), F.lit(missing).alias("missing"), "rows", "repeated", ((F.lit(missing) == "") & F.coalesce(F.col("repeated") == 0, F.lit(False))).alias("ok"))
        out = rows if out is None else out.unionByName(rows)
    return out


def parameterised(spark: SparkSession, sql: str, values: list, **views: DataFrame) -> DataFrame:
    """Rows of a statement with a ``?`` for each of ``values``, which travel beside the text and never in it.

    Question marks in quoted text are text. ``{name}`` stands for the view of that name.
    """
    bare = re.sub(r"'(?:[^']|'')*'", "", sql)
    if bare.count("?") != len(values):
        raise ValueError(f"{bare.count('?')} places for {len(values)} values")
    return spark.sql(sql, args=values, **views)
