"""What leaves the engine: payloads, storage paths, retained snapshots, CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of reports, days that their objects and links last, largest size in bytes.
REPORT_TYPES = ("monthly", "guideline")
MAX_BYTES = 10 * 1024 * 1024


def payload(event: str, created: Column, *fields: str) -> Column:
    """JSON of an event: its kind, its time in UTC with milliseconds, its fields."""
    at = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(F.lit(event).alias("event_type"), at.alias("occurred_at"), F.struct(*fields).alias("data")))


def storage_path(kind: Column, company: Column, period: Column, name: Column) -> Column:
    """reports/kind/company/yyyy/mm/name; null where the period is not yyyy-mm."""
    ok = period.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    return F.when(ok, F.concat_ws("/", F.lit("reports"), kind, company, F.substring(period, 1, 4), F.substring(period, 6, 2), name))


def retained(snapshot: DataFrame, new: DataFrame, key: str, time: str, since: str) -> DataFrame:
    """Snapshot after a run: new entries in place of those of the same key, entries before ``since`` gone."""
    merged = snapshot.join(new.select(key), key, "left_anti").unionByName(new)
    return merged.where(F.col(time) >= F.lit(since).cast(snapshot.schema[time].dataType))


def within_limit(size: Column) -> Column:
    """Whether an object may be stored."""
    return (size > 0) & (size <= MAX_BYTES)


def expiry(created: Column, object_days: Column, link_days: Column) -> tuple[Column, Column]:
    """When an object and its link end; a link never outlives its object."""
    object_end = F.date_add(created, object_days)
    return object_end, F.least(F.date_add(created, link_days), object_end)


def united(tables: list[DataFrame]) -> DataFrame:
    """Rows of tables of unlike columns under the union of their headers, in the order in which columns first appear."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV files with a header behind a byte order mark, so that spreadsheets read them as UTF-8.

    Values are quoted where they have to be; the first header stays unquoted, so that the mark is what a file begins
    with. Each part file is complete, mark and header included. Null is empty; in a table of one column it is a pair of
    quotes, as readers skip blank lines.
    """
    first, *names = rows.columns
    if not names:
        rows = rows.select(F.coalesce(F.col(first).cast("string"), F.lit("")).alias(first))
    rows.toDF("\ufeff" + first, *names).write.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def dump(collection: DataFrame, path: str, fields: list[str], tenant: str | None = None, tenant_key: str = "company_id") -> DataFrame:
    """Write a collection's documents (id, metadata, document) as CSV: id, tenant, the metadata ``fields``, document.

    Only those of ``tenant``, or all if it is null; what the metadata lack is empty. Returns the rows that are written.
    """
    rows = collection if tenant is None else collection.where(F.col("metadata")[tenant_key] == tenant)
    columns = [F.coalesce(F.col("metadata")[f], F.lit("")).alias(f) for f in (tenant_key, *fields)]
    rows = rows.select("id", *columns, F.coalesce("document", F.lit("")).alias("document"))
    write_csv(rows, path)
    return rows


def swap(rows: DataFrame, path: str) -> None:
    """Replace the table at ``path``: written beside it, then renamed. Between the two renames the path is missing for a moment.

    For readers that must never see that, there is :func:`publish`.
    """
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, now, old = hadoop(f"{path}.new"), hadoop(path), hadoop(f"{path}.old")
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, now):
        raise OSError(f"{path}.new could not be moved to {path}")
    fs.delete(old, True)


def publish(rows: DataFrame, path: str) -> int:
    """Write ``rows`` as the next version of the table at ``path`` and point readers to it; returns its number.

    A version is a folder of its own. The pointer is a small file that is replaced by one rename over the old one, so
    readers see the old version or the new one, whole. The version before stays for those that have begun to read it,
    older ones go.
    """
    spark, jvm = rows.sparkSession, rows.sparkSession.sparkContext._jvm
    hadoop, conf = jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    fs = hadoop.Path(path).getFileSystem(conf)
    before = _pointed(spark, path)
    number = (before or 0) + 1
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    new = hadoop.Path(f"{path}/_next")
    out = fs.create(new, True)
    out.writeBytes(str(number))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    over[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(hadoop.Path(f"{path}/_current")), over)
    for n in range(max(1, number - 3), number - 1):
        fs.delete(hadoop.Path(f"{path}/v{n}"), True)
    return number


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table made by :func:`publish`."""
    number = _pointed(spark, path)
    if number is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    return spark.read.parquet(f"{path}/v{number}")


def _pointed(spark: SparkSession, path: str) -> int | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    file = fs.open(at)
    text = file.readLine()
    file.close()
    return int(text)


def partitioned_or_aside(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that a sink takes and those that it would refuse (null counts as refused), so that one bad row stops no batch."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def write_partitioned(rows: DataFrame, path: str, by: list[str]) -> None:
    """Parquet below one folder for each value; a folder's rows are gathered first, so that it gets few files."""
    rows.repartition(*by).write.partitionBy(*by).parquet(path)
