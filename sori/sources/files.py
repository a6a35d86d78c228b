"""Sources of files: streams to replay, catalogs, state with corrupt entries, corpora of JSON, stages of a report, prompts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

MARK = "\ufeff"


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table as text columns; the byte order mark before its header is no part of the first name."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').option("multiLine", True).csv(path)
    return rows.toDF(*(c.removeprefix(MARK) for c in rows.columns))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path (or matches a pattern) in whatever store Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def event_streams(spark: SparkSession, files: dict[str, tuple[str, str | None, str, str]]) -> DataFrame:
    """Events of several CSV files in one table: stream, event_id, occurred_at, payload (JSON of the row).

    ``files`` names for each stream its path, id column, time column and prefix of ids; without an id column ids are
    numbers of rows, unique but not without gaps. Streams whose file is not there have no events. A byte order mark is
    skipped; a time that cannot be read is null. Files with different columns fit, as rows travel as JSON.
    """
    out = spark.createDataFrame([], "stream string, event_id string, occurred_at timestamp, payload string")
    for stream, (path, key, time, prefix) in files.items():
        if not exists(spark, path):
            continue
        rows = csv(spark, path)
        own = F.col(key) if key else F.monotonically_increasing_id().cast("string")
        out = out.unionByName(rows.select(F.lit(stream).alias("stream"), F.concat(F.lit(prefix), own).alias("event_id"), F.try_to_timestamp(F.col(time)).alias("occurred_at"), F.to_json(F.struct(*rows.columns)).alias("payload")))
    return out


def catalog(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows of a CSV catalog whose key is not blank, with keys trimmed."""
    return csv(spark, path).withColumn(key, F.trim(key)).where(F.col(key) != "")


def state(spark: SparkSession, path: str, schema: StructType, time: str, since: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Entries of a JSON-lines state that can be read and are not older than ``since``; attempts below 0 count as 0.

    An entry that is no JSON, does not fit the schema or lacks a ``required`` field goes alone. No file: no entries.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    corrupt = "_corrupt"
    rows = spark.read.schema(StructType([*schema.fields]).add(corrupt, "string")).option("columnNameOfCorruptRecord", corrupt).json(path)
    rows = rows.where(F.col(corrupt).isNull() & (F.col(time) >= F.lit(since).cast(schema[time].dataType))).drop(corrupt)
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows.withColumn("attempts", F.greatest(F.coalesce("attempts", F.lit(0)), F.lit(0))) if "attempts" in rows.columns else rows


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Texts in Unicode's composed form; each distinct one is composed once a batch."""
    return text.map({t: unicodedata.normalize("NFC", t) for t in text.dropna().unique()})


def json_corpus(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of all JSON files under a folder (arrays, one per file): uid (file name and place), split (the folder's name), columns.

    Names are in composed form, whatever form the store keeps them in. A file is parsed object by object as it is read,
    so its text is never held as a whole; a file that is no JSON has no objects. Places are numbered within a file.
    ``schema`` is the objects' type, struct<...>.
    """
    fields = spark.sql(f"SELECT CAST(NULL AS {schema}) AS s").schema["s"].dataType
    rows = spark.read.schema(fields).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    decoded = lambda c: composed(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))))
    rows = rows.select("*", F.element_at(parts, -1).alias("_file"), F.element_at(parts, -2).alias("_folder"), F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_order"))
    place = F.row_number().over(Window.partitionBy("_path").orderBy("_order")) - 1
    rows = rows.withColumn("_at", place)
    return rows.select(F.concat_ws("#", decoded(F.col("_file")), "_at").alias("uid"), decoded(F.col("_folder")).alias("split"), *fields.names)


def monthly_inputs(spark: SparkSession, folder: str, month: str, schema: str) -> DataFrame:
    """What the first stage of a month's report left (JSON lines below ``folder/month=...``), for the second stage.

    A month that was never aggregated is an error, not an empty report.
    """
    path = f"{folder}/month={month}"
    if not exists(spark, path):
        raise FileNotFoundError(f"no aggregated inputs of {month} at {path}: run the first stage before the second")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def relation(spark: SparkSession, name: str, url: str | None = None, properties: dict[str, str] | None = None, folder: str | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table of a database (``url`` and ``properties`` of JDBC, read only) or of a folder of Parquet tables.

    ``partition`` (column, low, high, parts) splits a database's table into ranges that are read side by side. A source
    that is not there is a FileNotFoundError that names it; nothing is created by looking.
    """
    if url is None and not exists(spark, f"{folder}/{name}.parquet"):
        raise FileNotFoundError(f"there is no table {name} in {folder}")
    try:
        if url is None:
            return spark.read.parquet(f"{folder}/{name}.parquet")
        split = dict(zip(("column", "lowerBound", "upperBound", "numPartitions"), partition, strict=True)) if partition else {}
        return spark.read.jdbc(url, name, properties={"readOnly": "true", **(properties or {})}, **split)
    except AnalysisException as error:
        raise FileNotFoundError(f"there is no table {name} at {url or folder}") from error


def examples(prompt: Column, pattern: str) -> Column:
    """Examples that a prompt holds: the first group of every match."""
    return F.regexp_extract_all(prompt, F.lit(pattern), 1)
