"""Queries of file sources, over files that each query writes from the tables first."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from sori.operators import monthly as M
from sori.operators import outputs as O
from sori.plans.lookups import table
from sori.plans.registry import query
from sori.sources import files
from sori.sources.shared import shared_path
from sori.sources.voc import documents

#: Fixed value: how a prompt marks an example.
EXAMPLE = r'입력: "(.+?)"'


@query("""SELECT CASE WHEN source = 'cs' THEN 'inquiries' ELSE 'reviews' END AS stream, CASE WHEN source = 'cs' THEN 'INQ-' ELSE 'RVW-' END || item_id AS event_id,
  CASE WHEN k % 50 <> 4 THEN strftime(occurred_at, '%Y-%m-%d %H:%M:%S') END AS at, CASE WHEN source = 'cs' THEN product || ', "' || k || '"' ELSE aspect END AS said FROM voc
UNION ALL SELECT 'orders', 'ORD-', strftime(day, '%Y-%m-%d 00:00:00'), product FROM (SELECT DISTINCT day, product FROM voc)""")
def s06_streams(spark, sf):
    """Inquiries, reviews and orders as CSV files with unlike columns and marks; one stream has no file, one no ids."""
    path, docs = shared_path(spark, "streams"), documents(spark, sf)
    at = F.when(F.col("k") % 50 == 4, "soon").otherwise(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))
    quoted = F.concat("product", F.lit(', "'), F.col("k").cast("string"), F.lit('"'))
    O.write_csv(docs.where("source = 'cs'").select(F.col("item_id").alias("inquiry_id"), at.alias("inquired_at"), quoted.alias("content")), f"{path}/cs")
    O.write_csv(docs.where("source = 'review'").select(F.col("item_id").alias("review_id"), "aspect", at.alias("created_at")), f"{path}/reviews")
    O.write_csv(docs.select(F.col("day").cast("string").alias("order_date"), "product").distinct(), f"{path}/orders")
    rows = files.event_streams(spark, {
        "inquiries": (f"{path}/cs", "inquiry_id", "inquired_at", "INQ-"), "reviews": (f"{path}/reviews", "review_id", "created_at", "RVW-"),
        "orders": (f"{path}/orders", None, "order_date", "ORD-"), "changes": (f"{path}/changes", "change_id", "changed_at", "CHG-"),
    })
    said = F.coalesce(*(F.get_json_object("payload", f"$.{c}") for c in ("content", "aspect", "product")))
    event = F.when(F.col("stream") == "orders", "ORD-").otherwise(F.col("event_id"))
    return rows.select("stream", event.alias("event_id"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("at"), said.alias("said"))


@query("SELECT 'events' AS name, TRUE AS found, count(*) AS n FROM events UNION ALL SELECT 'orders', TRUE, count(*) FROM orders UNION ALL SELECT 'inquiries', FALSE, 0")
def s01_relations(spark, sf):
    """Tables of a source by name; one that is not there is told apart from an empty one."""
    out = None
    for name in ("events", "orders", "inquiries"):
        try:
            rows = files.relation(spark, name, folder=sf).agg(F.lit(name).alias("name"), F.lit(True).alias("found"), F.count("*").alias("n"))
        except FileNotFoundError:
            rows = spark.range(1).select(F.lit(name).alias("name"), F.lit(False).alias("found"), F.lit(0).cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT trim(p_brand) || '-' || p_partkey AS variant, p_name AS name FROM part WHERE p_partkey % 10 <> 3")
def s07_catalog(spark, sf):
    """A catalog in which some keys are blank or null and others padded."""
    path, parts = shared_path(spark, "catalog"), table(spark, sf, "part")
    key = F.when(F.col("p_partkey") % 20 == 3, "  ").when(F.col("p_partkey") % 20 == 13, None).otherwise(F.concat(F.lit(" "), F.trim("p_brand"), F.lit("-"), F.col("p_partkey").cast("string")))
    O.write_csv(parts.select(key.alias("variant"), F.col("p_name").alias("name")), path)
    return files.catalog(spark, path, "variant")


@query("SELECT CASE WHEN conv_id % 3 = 0 THEN '검증' ELSE '학습' END AS split, role, text, count(*) AS n FROM conversations GROUP BY ALL")
def s08_corpus(spark, sf):
    """Turns as JSON files below two folders, whose names are stored in decomposed form."""
    path, turns = shared_path(spark, "corpus"), table(spark, sf, "conversations").select("conv_id", "role", "text")
    for name, part in (("검증", "conv_id % 3 = 0"), ("학습", "conv_id % 3 <> 0")):
        lines = turns.where(part).select(F.to_json(F.struct("role", "text")).alias("value")).mapInPandas(array_lines, "value string")
        lines.write.text(f"{path}/{unicodedata.normalize('NFD', name)}")
    for at in [f"{path}/{unicodedata.normalize('NFD', name)}" for name in ("검증", "학습")]:
        renamed(spark, at, ".txt", ".json")
    rows = files.json_corpus(spark, path, "struct<role:string,text:string>")
    return rows.groupBy("split", "role", "text").agg(F.count("*").alias("n"))


def array_lines(frames):
    """The lines of a JSON array with a partition's objects, one a line."""
    mark = "["
    for f in frames:
        if len(f):
            yield pd.DataFrame({"value": (mark + f["value"]).where(f.index == f.index[0], "," + f["value"])})
            mark = ","
    yield pd.DataFrame({"value": ["[]" if mark == "[" else "]"]})


def renamed(spark, folder: str, old: str, new: str) -> None:
    """Give the files below a folder another ending (a rename for each file)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{folder}/*{old}")):
        fs.rename(f.getPath(), path(f.getPath().toString().removesuffix(old) + new))


ENTRY = StructType([StructField("alert_id", StringType()), StructField("window_end", DateType()), StructField("attempts", IntegerType())])


def written_state(spark, sf: str, name: str) -> str:
    """Entries as JSON lines: some cut off, some of another type, some without their id, some with attempts below 0."""
    path, k = shared_path(spark, name), F.col("k")
    whole = F.to_json(F.struct(F.when(k % 19 != 4, F.concat(F.lit("A-"), F.col("item_id").cast("string"))).alias("alert_id"), F.col("day").alias("window_end"), F.when(k % 7 != 2, k % 5 - 1).alias("attempts")))
    typed = F.replace(whole, F.lit('"window_end":"'), F.lit('"window_end":{"day":"'))
    line = F.when(k % 17 == 3, F.substring(whole, F.lit(1), F.length(whole) - 5)).when(k % 23 == 5, F.concat(typed, F.lit("}"))).otherwise(whole)
    documents(spark, sf).select(line.alias("value")).write.text(path)
    return path


STATE = "SELECT 'A-' || item_id AS alert_id, day AS window_end, CAST(greatest(CASE WHEN k % 7 <> 2 THEN k % 5 - 1 ELSE 0 END, 0) AS INTEGER) AS attempts FROM voc WHERE k % 19 <> 4 AND k % 17 <> 3 AND k % 23 <> 5 AND day >= DATE '2024-01-12'"


@query(STATE, dates=("window_end",))
def s10_state(spark, sf):
    """Published alerts of the last days: entries that cannot be read or have no id go alone."""
    return files.state(spark, written_state(spark, sf, "state"), ENTRY, "window_end", "2024-01-12", required=("alert_id",))


@query("SELECT attempts, count(*) AS n, min(alert_id) AS first FROM (" + STATE + ") GROUP BY attempts UNION ALL SELECT -1, 0, NULL")
def s11_pending(spark, sf):
    """The queue of proposals by attempts; a queue that was never written is empty."""
    rows = files.state(spark, written_state(spark, sf, "queue"), ENTRY, "window_end", "2024-01-12", required=("alert_id",))
    never = files.state(spark, shared_path(spark, "no-queue"), ENTRY, "window_end", "2024-01-12")
    counted = rows.groupBy("attempts").agg(F.count("*").alias("n"), F.min("alert_id").alias("first"))
    return counted.unionByName(never.agg(F.lit(-1).alias("attempts"), F.count("*").alias("n"), F.min("alert_id").alias("first")))


@query("SELECT product, aspect, count(*) FILTER (sentiment = -1) AS neg, count(*) AS n, round(count(*) FILTER (sentiment = -1) / count(*), 9) AS neg_ratio FROM voc GROUP BY product, aspect")
def s12_monthly_inputs(spark, sf):
    """The first stage of a month's report, nested by product, written and read back by the second."""
    path = shared_path(spark, "monthly")
    rows = M.sentiment_ratios(documents(spark, sf))
    cell = F.struct("aspect", "neg", (F.col("pos") + F.col("neu") + F.col("neg")).alias("n"), F.round("neg_ratio", 9).alias("neg_ratio"))
    stage = rows.groupBy("product", F.date_format("month", "yyyy-MM").alias("month")).agg(F.collect_list(cell).alias("aspects"))  # one for each attribute
    stage.write.partitionBy("month").json(path)
    read = files.monthly_inputs(spark, path, "2024-01", "product string, aspects array<struct<aspect:string,neg:bigint,n:bigint,neg_ratio:double>>")
    return read.select("product", F.inline("aspects"))


@query("SELECT conv_id, role, replace(text, chr(34), chr(39)) AS example, count(*) AS n FROM conversations WHERE text <> '' AND NOT contains(text, chr(10)) GROUP BY ALL")
def s17_examples(spark, sf):
    """Examples that prompts quote: each conversation's turns are the examples of one prompt."""
    turns = table(spark, sf, "conversations").where(~F.contains("text", F.lit("\n")))
    line = F.concat(F.lit('입력: "'), F.replace("text", F.lit('"'), F.lit("'")), F.lit('"\n출력: -'))
    prompts = turns.groupBy("conv_id", "role").agg(F.array_join(F.collect_list(line), "\n").alias("prompt"))  # the turns of one conversation
    found = prompts.select("conv_id", "role", F.explode(files.examples(F.col("prompt"), EXAMPLE)).alias("example"))
    return found.groupBy("conv_id", "role", "example").agg(F.count("*").alias("n"))


@query("SELECT 'page-' || page_id AS id, 'C' || (page_id % 3) AS company_id, CASE WHEN page_id % 5 = 0 THEN NULL ELSE 'P' || (page_id % 7) END AS product_group_id, CASE WHEN page_id % 4 = 1 THEN NULL ELSE 'NAVER' END AS channel, sha256(coalesce(url, '')) AS document FROM pages WHERE page_id % 3 = 1")
def m22_dump(spark, sf):
    """One tenant's pages of a collection as CSV, and read back; what the metadata lack is empty."""
    path, page = shared_path(spark, "dump"), F.col("page_id")
    metadata = F.map_filter(F.create_map(
        F.lit("company_id"), F.concat(F.lit("C"), (page % 3).cast("string")),
        F.lit("product_group_id"), F.when(page % 5 != 0, F.concat(F.lit("P"), (page % 7).cast("string"))),
        F.lit("channel"), F.when(page % 4 != 1, "NAVER"),
    ), lambda _, v: v.isNotNull())
    collection = table(spark, sf, "pages").select(F.concat(F.lit("page-"), page.cast("string")).alias("id"), metadata.alias("metadata"), F.col("url").alias("document"))
    O.dump(collection, path, ["product_group_id", "channel"], tenant="C1")
    return files.csv(spark, path).withColumn("document", F.sha2(F.coalesce("document", F.lit("")), 256))
