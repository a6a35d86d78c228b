"""Incremental labelling: batches of documents, their labels and failures committed together; retries and backfills.

State is four tables. ``items``: item_id, version; ``labels``: item_id, aspect, sentiment; ``failures``: item_id, error,
attempts, first_failed_at, last_failed_at; ``cursor``: worker, occurred_at, item_id. A batch's results have item_id,
occurred_at, labels (array of aspect and sentiment; null if it failed), error and call_failed (the call itself failed,
not the answer's form).

What is stored is a log: each batch writes its own entries under its number, and the state is the last entry of each
document up to the newest complete batch. Now and then the log up to some batch is folded into one table of entries.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori.operators import snapshots as S
from sori.streaming.ingest import delete, unseen, written

LABELS = "array<struct<aspect:string,sentiment:int>>"
ITEMS = "item_id long, version string"
ASPECTS = "item_id long, aspect string, sentiment int"
FAILURES = "item_id long, error string, attempts int, first_failed_at date, last_failed_at date"
CURSOR = "worker string, occurred_at timestamp_ntz, item_id long"
#: Tables of a batch. ``seen_on`` is the day of the document; a failure without attempts is cleared. The one row of
#: ``cursor`` is written last and makes the batch count; documents and late describe what came with it.
LOGS = {
    "items": f"batch long, seen_on date, item_id long, version string, labels {LABELS}",
    "failures": f"batch long, seen_on date, {FAILURES}",
    "cursor": f"batch long, {CURSOR}, documents long, late long",
}
#: Attempts from which a failed document is left alone.
MAX_ATTEMPTS = 3


@dataclass
class State:
    """Tables of a worker after some batch; ``changes`` are the entries that this batch adds to the logs."""

    items: DataFrame
    labels: DataFrame
    failures: DataFrame
    cursor: DataFrame
    changes: dict[str, DataFrame] | None = None

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(*(spark.createDataFrame([], s) for s in (ITEMS, ASPECTS, FAILURES, CURSOR)))


class Halted(RuntimeError):
    """A whole batch failed, and not for what its documents hold."""


def labelled(results: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Items and labels of the documents that did not fail; a document without labels still is an item."""
    done = results.where("labels IS NOT NULL")
    return done.select("item_id", F.lit(version).alias("version")), done.select("item_id", F.inline("labels"))


def changes_of(state: State, results: DataFrame, version: str, worker: str = "worker", advance: bool = True) -> dict[str, DataFrame]:
    """Log entries of a batch on top of ``state``: its items with their labels, its failures counted, those of documents that succeeded cleared.

    Only documents of the batch occur, whatever the state holds. The cursor's entry is the batch's last document, failed
    or not (what failed is found in ``failures``); retries and backfills have none (``advance`` false).
    """
    day = F.col("occurred_at").cast("date")
    done = results.where("labels IS NOT NULL").select(day.alias("seen_on"), "item_id", F.lit(version).alias("version"), "labels")
    failed = results.where("labels IS NULL").select("item_id", "error", day.alias("at"))
    before = state.failures.join(results.select("item_id"), "item_id", "left_semi")
    again = S.record_failures(before.join(failed.select("item_id"), "item_id", "left_semi"), failed)
    failures = failed.select("item_id", F.col("at").alias("seen_on")).join(again, "item_id")
    columns = [c.split()[0] for c in FAILURES.split(", ")]
    cleared = before.select("item_id").join(done.select("item_id", "seen_on"), "item_id")
    cleared = cleared.select("seen_on", "item_id", *(F.lit(None).cast(state.failures.schema[c].dataType).alias(c) for c in columns[1:]))
    last = F.max(F.struct(F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"), "item_id"))
    late = F.lit(0)
    if advance:
        old = state.cursor.where(F.col("worker") == worker).first()  # one row for each worker
        late = F.count_if(F.col("occurred_at").cast("timestamp_ntz") < F.lit(old["occurred_at"] if old else None).cast("timestamp_ntz"))
    else:
        last = F.lit(None).cast("struct<occurred_at:timestamp_ntz,item_id:bigint>")
    cursor = results.agg(last.alias("last"), F.count("*").alias("documents"), late.cast("long").alias("late"))
    return {"items": done, "failures": failures.select("seen_on", *columns).unionByName(cleared), "cursor": cursor.select(F.lit(worker).alias("worker"), "last.occurred_at", "last.item_id", "documents", "late")}


def newest(cursors: DataFrame) -> DataFrame:
    """Each worker's furthest place: late batches never move it back."""
    rows = cursors.where("occurred_at IS NOT NULL").groupBy("worker").agg(F.max(F.struct("occurred_at", "item_id")).alias("last"))
    return rows.select("worker", "last.occurred_at", "last.item_id")


def applied(state: State, results: DataFrame, version: str, worker: str = "worker", advance: bool = True) -> State:
    """State after a batch: items replaced with their labels, failures counted or cleared, the cursor moved forward."""
    changes = changes_of(state, results, version, worker, advance)
    items = changes["items"]
    labels = state.labels.join(items.select("item_id"), "item_id", "left_anti").unionByName(items.select("item_id", F.inline("labels")))
    failures = S.upsert(state.failures, changes["failures"].drop("seen_on"), ["item_id"]).where("attempts IS NOT NULL")
    cursor = newest(state.cursor.unionByName(changes["cursor"].select(*state.cursor.columns)))
    return State(S.upsert(state.items, items.select("item_id", "version"), ["item_id"]), labels, failures, cursor, changes)


def halts(results: DataFrame, by: list[str]) -> DataFrame:
    """For each batch whether to stop: all documents failed and at least one because its call did.

    Answers of the wrong form are the documents' own fault, however many there are.
    """
    failed, calls = F.count_if(F.col("labels").isNull()), F.count_if(F.col("labels").isNull() & F.col("call_failed"))
    rows = results.groupBy(*by).agg(F.count("*").alias("documents"), failed.alias("failed"), calls.alias("calls"))
    return rows.withColumn("halt", (F.col("documents") == F.col("failed")) & (F.col("calls") > 0))


def retryable(failures: DataFrame, docs: DataFrame, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Documents to try once more: failed fewer than ``attempts`` times and still there."""
    return docs.join(failures.where(F.col("attempts") < attempts).select("item_id"), "item_id", "left_semi")


def stale(items: DataFrame, docs: DataFrame, version: str) -> DataFrame:
    """Documents with content that another version labelled, an unknown (null) one included."""
    old = items.where(~F.col("version").eqNullSafe(version)).select("item_id")
    return docs.where(F.trim("content") != "").join(old, "item_id", "left_semi")


def retrying(action: Callable[[], State], times: int = 3, wait: float = 2.0) -> State:
    """What ``action`` returns; an input or output error is tried again after 2, 4, ... seconds, the last one is raised."""
    for attempt in range(1, times):
        try:
            return action()
        except (OSError, Py4JJavaError):
            time.sleep(wait**attempt)
    return action()


def commit(state: State, path: str, batch_id: int) -> State:
    """Write the entries that a batch adds and make them count; the same batch written again replaces itself.

    What is written grows with the batch, not with the state. The cursor's entry is written last and its presence is
    looked for first, so that a batch counts either whole or not at all.
    """
    spark, at = state.items.sparkSession, f"{path}/changes/{batch_id}"
    if state.changes is None:
        raise ValueError("only a state that a batch was applied to can be committed")
    delete(spark, f"{at}/cursor")
    for name in ("items", "failures", "cursor"):
        state.changes[name].select(F.lit(batch_id).cast("long").alias("batch"), "*").write.mode("overwrite").parquet(f"{at}/{name}")
    return current(spark, path)


def entries(spark: SparkSession, path: str, name: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries of a log: those folded so far, one for each document, and those of the complete batches since."""

    def read(places: list[str]) -> DataFrame:
        return spark.read.schema(LOGS[name]).parquet(*places) if places else spark.createDataFrame([], LOGS[name])

    folds = [n for n in written(spark, f"{path}/folded", "cursor") if before is None or n < before]
    since = folds[-1] if folds else -1
    numbers = [n for n in written(spark, f"{path}/changes", "cursor") if n > since and (before is None or n < before)]
    return read([f"{path}/folded/{n}/{name}" for n in folds[-1:]]), read([f"{path}/changes/{n}/{name}" for n in numbers])


def latest(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """Each document's last entry. Only the batches since the last fold are grouped; what was folded is joined by key."""
    folded, recent = entries(spark, path, name, before)
    recent = recent.groupBy("item_id").agg(F.max_by(F.struct("*"), "batch").alias("last")).select("last.*")
    return S.upsert(folded, recent, ["item_id"])


def current(spark: SparkSession, path: str, before: int | None = None) -> State:
    """The state after the last complete batch (of a number below ``before``); an empty one if there is none."""
    items, failures = (latest(spark, path, name, before) for name in ("items", "failures"))
    folded, recent = entries(spark, path, "cursor", before)
    columns = [c.split()[0] for c in FAILURES.split(", ")]
    return State(items.select("item_id", "version"), items.select("item_id", F.inline("labels")), failures.where("attempts IS NOT NULL").select(*columns), newest(folded.unionByName(recent)))


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """What came with each batch since the last fold: batch, documents, late (older than the cursor before it)."""
    return entries(spark, path, "cursor")[1].select("batch", "documents", "late")


def fold(spark: SparkSession, path: str, upto: int) -> None:
    """Write each document's last entry up to batch ``upto`` as one table; entries older than the fold before go.

    Readers that began before keep their files, as one generation stays. Entries lie in the order of days, so that a
    look-up by days skips the rest.
    """
    before = [n for n in written(spark, f"{path}/folded", "cursor") if n < upto]
    at = f"{path}/folded/{upto}"
    delete(spark, f"{at}/cursor")
    for name in ("items", "failures"):
        latest(spark, path, name, upto + 1).repartitionByRange("seen_on", "item_id").sortWithinPartitions("seen_on").write.mode("overwrite").parquet(f"{at}/{name}")
    folded, recent = entries(spark, path, "cursor", upto + 1)
    rows = newest(folded.unionByName(recent)).select(F.lit(upto).cast("long").alias("batch"), "*", F.lit(None).cast("long").alias("documents"), F.lit(None).cast("long").alias("late"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{at}/cursor")
    for old in before[:-1]:
        delete(spark, f"{path}/folded/{old}")
    for n in written(spark, f"{path}/changes", "cursor") if before else []:
        if n <= before[-1]:
            delete(spark, f"{path}/changes/{n}")


def new_events(events: DataFrame, path: str, before: int | None = None, key: str = "event_id", time: str = "ts") -> DataFrame:
    """Events whose document no batch (below ``before``) has seen, late ones included; ``key`` is the document's item_id."""
    spark, known = events.sparkSession, None
    for name in ("items", "failures"):
        for rows in entries(spark, path, name, before):
            rows = rows.select(F.col("item_id").alias(key), "seen_on")
            known = rows if known is None else known.unionByName(rows)
    return unseen(events, known, key, time)


def follow(spark: SparkSession, source: str, schema, path: str, prepare: Callable[[DataFrame], DataFrame], classify: Callable[[DataFrame], DataFrame], version: str, files_per_batch: int = 4, interval: str | None = None, time_column: str = "ts", key: str = "event_id", fold_every: int = 32):
    """Label what is and what arrives below ``source``, batch by batch, each committed under its number.

    ``prepare`` turns raw events into documents (item_id, which is their ``key``, and occurred_at), ``classify`` these
    into results. Files may come in any order of time: an event that was seen before, by its key and day, is left out;
    any other one is labelled, however late, and the cursor stays where it is if the batch is older. A batch that is
    repeated after a crash starts from the state before it and replaces itself. Without ``interval`` the stream ends
    when all files are read. A batch that :func:`halts` raises, and stays to be read again. Every ``fold_every`` batches
    the logs are folded.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % fold_every == 0:
            fold(spark, path, batch_id - 1)  # which the stream has left behind for good
        results = classify(prepare(new_events(batch, path, batch_id, key, time_column))).persist()
        try:
            if results.isEmpty():
                return
            if halts(results.withColumn("batch", F.lit(batch_id)), ["batch"]).first()["halt"]:
                raise Halted(f"batch {batch_id}: every document failed")
            state = applied(current(spark, path, batch_id), results, version)
            retrying(lambda: commit(state, path, batch_id))
        finally:
            results.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger).start()
    if not interval:
        query.awaitTermination()
    return query


def dispatched(failed: DataFrame, final: list[str]) -> DataFrame:
    """Adds route to failed messages: those whose ``error`` is one of ``final`` would fail again and are put aside, others return."""
    return failed.withColumn("route", F.when(F.col("error").isin(*final), "aside").otherwise("again"))
