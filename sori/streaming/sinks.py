"""A sink of several tables: a batch's rows count in all tables at once, rows that a table refuses are put aside alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sori.streaming.ingest import delete, written

ASIDE = "table_name string, key string, reason string"


@dataclass(frozen=True)
class Table:
    """Which rows of a batch a table takes, and its columns as expressions that raise an error for what it refuses.

    ``refused`` names what can be foreseen (reason: condition): such rows are put aside in one pass, however many.
    """

    rows: Column
    columns: tuple[Column, ...]
    refused: dict[str, Column] = field(default_factory=dict)


def required(value: Column, name: str) -> Column:
    """``value``; an error if it is null."""
    return F.coalesce(value, F.raise_error(F.lit(f"{name} is missing")))


def isolated(rows: DataFrame, key: str, write: Callable[[DataFrame, str], None], most: int = 1000) -> list[tuple[str, str]]:
    """Write ``rows`` part by part so that all but the rows that fail are written; those (key as text, reason) are returned.

    ``write(part, name)`` writes a part under a name of its own or raises. As long as nothing fails there is one part;
    a part that fails is cut in two by a hash of the key, down to single keys, so one bad row among n costs about
    2 log2(n) writes of shrinking parts. Foreseeable refusals belong into a filter before (``Table.refused``);
    more than ``most`` bad keys raise the last error, as then the sink is at fault and not a row.
    """
    bad: list[tuple[str, str]] = []
    place = F.xxhash64(F.lit("part"), F.col(key).cast("string"))
    todo = [("all", rows, 0)]
    while todo:
        name, part, depth = todo.pop()
        try:
            write(part, name)
            continue
        except PySparkException as error:
            keys = [r[0] for r in part.select(F.col(key).cast("string")).distinct().limit(2).collect()]
            if len(keys) == 1 or depth == 64:
                if len(bad) >= most:
                    raise
                bad += [(k, _reason(error)) for k in keys]
                continue
        bit = F.shiftrightunsigned(place, depth) % 2 if depth < 63 else F.when(place < 0, 1).otherwise(0)
        todo += [(f"{name}-{b}", part.where(F.abs(bit) == b), depth + 1) for b in (0, 1)]
    return bad


def _reason(error: PySparkException) -> str:
    """The first line of what an error says, without its class and state."""
    first = str(error).strip().splitlines()[0]
    return first.split("SQLSTATE")[0].strip()[:200]


def write_batch(batch: DataFrame, batch_id: int, path: str, tables: dict[str, Table], key: str, most: int = 1000) -> None:
    """Write a batch's rows to their tables under its number; the same batch again replaces itself.

    Rows that a table foreseeably refuses never reach it: they go aside with their reason by one pass for each table.
    The table ``aside`` (table_name, key, reason) is written last and makes the batch count: readers see all tables of a
    batch or none. A row that no table takes is left out, one that several take goes to each.
    """
    spark, at = batch.sparkSession, f"{path}/{batch_id}"
    delete(spark, at)
    batch, bad, foreseen = batch.persist(), [], []
    try:
        for name, table in tables.items():
            columns = list(table.columns)

            def write(part: DataFrame, part_name: str, name=name, columns=columns) -> None:
                part.select(*columns).write.mode("overwrite").parquet(f"{at}/{name}/{part_name}")

            rows = batch.where(table.rows)
            if table.refused:
                reason = F.coalesce(*(F.when(when, why) for why, when in table.refused.items()))
                foreseen.append(rows.where(reason.isNotNull()).select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), reason.alias("reason")))
                rows = rows.where(reason.isNull())
            bad += [(name, k, reason) for k, reason in isolated(rows, key, write, most)]
        reduce(DataFrame.unionByName, foreseen, spark.createDataFrame(bad, ASIDE).coalesce(1)).write.mode("overwrite").parquet(f"{at}/aside")
    finally:
        batch.unpersist()


def read_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of a table, from complete batches only; ``aside`` is a table like the others."""
    places = [f"{path}/{n}/{name}" for n in written(spark, path, "aside")]
    parts = [spark.read.schema(schema).parquet(p if name == "aside" else f"{p}/*") for p in places if name == "aside" or written_parts(spark, p)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def written_parts(spark: SparkSession, path: str) -> bool:
    """Whether a table got any part in a batch; a part that failed leaves no finished one behind."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def follow_tables(spark: SparkSession, source: str, schema, path: str, prepare: Callable[[DataFrame], DataFrame], tables: dict[str, Table], key: str, files_per_batch: int = 8, interval: str | None = None):
    """Write what is and what arrives below ``source`` to the tables; a batch ends at so many files or after ``interval``.

    Offsets and tables are kept together by the batch number, so rows are neither lost nor written twice by a crash;
    nothing waits in memory between batches. Without ``interval`` the stream ends when all files are read.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    query = stream.writeStream.foreachBatch(lambda rows, n: write_batch(prepare(rows), n, f"{path}/batches", tables, key)).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger).start()
    if not interval:
        query.awaitTermination()
    return query
