"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of documents in one Arrow batch; bounds what a Python worker holds of one batch.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, and only on one machine, a new one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="sori-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sori-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs no more than the tasks since then."""
    spark = df.sparkSession
    # Shuffle files of a finished write are of no more use; without this they stay until the driver collects garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for p in paths:
        if "/sori-" in p:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Python workers get documents in small Arrow batches from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings (dots as __) for the jobs that run inside, back to what they were afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    held = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def heavy(spark: SparkSession, rows: int):
    """For work that costs far more than its bytes: shuffled partitions stay small, and so do Arrow batches."""
    return settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="512k", spark__sql__execution__arrow__maxRecordsPerBatch=str(rows))


def with_base(totals: DataFrame, key: str, amount: str, base: str = "base") -> DataFrame:
    """Exclusive prefix sums of ``amount`` in the order of the integer ``key`` (one row per key).

    Two levels of sums, so that no task sorts more than a thousandth of the keys or a thousand of them.
    """
    totals = totals.withColumn("_blk", F.floor(F.col(key) / 1024))
    before = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("_blk").agg(F.sum(amount).alias("_sum"))
    blocks = blocks.select("_blk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inner.join(blocks, "_blk").withColumn(base, (F.col("_before") + F.col("_in")).cast("long")).drop("_blk", "_in", "_before")
