"""Queries of incremental labelling: batches, retries, backfills, halts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori.plans.registry import query
from sori.sources.shared import shared_path
from sori.sources.voc import documents, projected
from sori.streaming import worker as W
from sori.streaming.ingest import drain
from sori.streaming.sinks import Table, follow_tables, read_table, required
from sori.streaming.suppression import OUTPUT, suppressed
from sori.streaming.windows import keep_updates, newest_counts, sliding_counts

RESULTS = """, x AS (
  SELECT *, k % 9 = 0 AS bad, CASE WHEN k % 2 = 0 THEN 'timeout' ELSE 'parse' END AS error, k % 9 = 0 AND k % 2 = 0 AS call_failed FROM voc
), b1 AS (SELECT * FROM x WHERE day < DATE '2024-01-15'), b2 AS (SELECT *, k % 18 = 0 AS bad2 FROM x WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20')
"""


def results(docs: DataFrame, bad: str = "k % 9 = 0") -> DataFrame:
    """Answers of a stand-in for a model: documents of some ``k`` fail, neutral ones have no label."""
    failed = F.expr(bad)
    labels = F.when(F.col("sentiment") == 0, F.array().cast(W.LABELS)).otherwise(F.array(F.struct("aspect", F.col("sentiment").cast("int").alias("sentiment"))))
    error = F.when(failed, F.when(F.col("k") % 2 == 0, "timeout").otherwise("parse"))
    return docs.withColumns({"labels": F.when(~failed, labels), "error": error, "call_failed": failed & (F.col("k") % 2 == 0)})


def flat(state: W.State) -> DataFrame:
    """The tables of a state in one: kind, item_id, name, n."""
    return (
        state.items.select(F.lit("item").alias("kind"), "item_id", F.col("version").alias("name"), F.lit(1).cast("long").alias("n"))
        .unionByName(state.labels.select(F.lit("label").alias("kind"), "item_id", F.col("aspect").alias("name"), F.col("sentiment").cast("long").alias("n")))
        .unionByName(state.failures.select(F.lit("failure").alias("kind"), "item_id", F.col("error").alias("name"), F.col("attempts").cast("long").alias("n")))
        .unionByName(state.cursor.select(F.lit("cursor").alias("kind"), "item_id", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("name"), F.lit(1).cast("long").alias("n")))
    )


@query(RESULTS + """, i AS (
  SELECT item_id, 'v2' AS version, aspect, sentiment FROM b2 WHERE NOT bad2
  UNION ALL SELECT item_id, 'v1', aspect, sentiment FROM b1 WHERE NOT bad AND item_id NOT IN (SELECT item_id FROM b2 WHERE NOT bad2)
), f AS (
  SELECT item_id, b2.item_id IS NOT NULL AS again, b1.error FROM b1 LEFT JOIN b2 USING (item_id) WHERE b1.bad AND coalesce(bad2, TRUE)
), g AS (SELECT item_id, CASE WHEN again THEN 'timeout' ELSE error END AS error, CASE WHEN again THEN 2 ELSE 1 END AS attempts FROM f
  UNION ALL SELECT item_id, 'timeout', 1 FROM b2 WHERE bad2 AND item_id NOT IN (SELECT item_id FROM b1))
SELECT 'item' AS kind, item_id, version AS name, CAST(1 AS BIGINT) AS n FROM i
UNION ALL SELECT 'label', item_id, aspect, sentiment FROM i WHERE sentiment <> 0
UNION ALL SELECT 'failure', item_id, error, attempts FROM g
UNION ALL SELECT * FROM (SELECT 'cursor', item_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S'), 1 FROM b2 ORDER BY occurred_at DESC, item_id DESC LIMIT 1)""")
def k05_committed_batches(spark, sf):
    """Two overlapping batches, the second written twice under its number."""
    docs, path = documents(spark, sf), shared_path(spark, "batches")
    W.commit(W.applied(W.State.empty(spark), results(docs.where("day < '2024-01-15'")), "v1"), path, 0)
    second = results(docs.where("day BETWEEN '2024-01-10' AND '2024-01-20'"), "k % 18 = 0")
    for _ in range(2):
        W.commit(W.applied(W.current(spark, path, 1), second, "v2"), path, 1)
    return flat(W.current(spark, path))


@query(RESULTS + """SELECT 'item' AS kind, item_id, 'v1' AS name, CAST(1 AS BIGINT) AS n FROM x WHERE NOT bad
UNION ALL SELECT 'label', item_id, aspect, sentiment FROM x WHERE NOT bad AND sentiment <> 0
UNION ALL SELECT 'failure', item_id, error, 1 FROM x WHERE bad
UNION ALL SELECT * FROM (SELECT 'cursor', item_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S'), 1 FROM x ORDER BY occurred_at DESC, item_id DESC LIMIT 1)""")
def r02_followed(spark, sf):
    """The stream over all event files, drained; its state equals that of one batch over everything."""
    path, source = shared_path(spark, "followed"), f"{sf}/event[s].parquet"  # a pattern, as a stream takes no single file
    W.follow(spark, source, spark.read.parquet(f"{sf}/events.parquet").schema, path, projected, results, "v1")
    return flat(W.current(spark, path))


#: Events in five parts by day, the parts in no order of time; copies of a part's events come again with the next one.
PARTS = 5
PART = f"date_diff('day', DATE '2024-01-01', day) * 2 % {PARTS}"
ARRIVED = f""", a AS (
  SELECT item_id, occurred_at, {PART} AS part FROM voc
), m AS (
  SELECT part, count(*) AS documents, max(max(occurred_at)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM a GROUP BY part
)"""


def arriving(spark: SparkSession, sf: str, name: str):
    """Paths to which the parts are written one after another, each with copies of some events of the part before it."""
    path, events = shared_path(spark, name), spark.read.parquet(f"{sf}/events.parquet")
    part = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 2 % PARTS
    rows = events.withColumn("_part", part)
    for n in range(PARTS):
        mine = (F.col("_part") == n) | ((F.col("_part") == n - 1) & (F.col("event_id") % 5 == 0))
        rows.where(mine).drop("_part").write.mode("append").parquet(f"{path}/in")
        yield path, events.schema


@query(ARRIVED + "SELECT part AS batch, count(*) AS documents, count(DISTINCT item_id) AS ids FROM a GROUP BY part")
def r03_drained(spark, sf):
    """A stream drained whenever files have come, and stopped: parts out of order and copies, each event written once."""
    for path, schema in arriving(spark, sf, "drained"):
        drain(spark, f"{path}/in", schema, f"{path}/checkpoint", lambda rows, n, at=path: rows.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), files_per_batch=100_000)
    return spark.read.parquet(f"{path}/out").groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("documents"), F.countDistinct("event_id").alias("ids"))


@query(RESULTS + """SELECT 'item' AS kind, item_id, 'v1' AS name, CAST(1 AS BIGINT) AS n FROM x WHERE NOT bad
UNION ALL SELECT 'label', item_id, aspect, sentiment FROM x WHERE NOT bad AND sentiment <> 0
UNION ALL SELECT 'failure', item_id, error, 1 FROM x WHERE bad
UNION ALL SELECT * FROM (SELECT 'cursor', item_id, strftime(occurred_at, '%Y-%m-%d %H:%M:%S'), 1 FROM x ORDER BY occurred_at DESC, item_id DESC LIMIT 1)""")
def r02_late_files(spark, sf):
    """Files in no order of time, weeks late, with copies, over several runs and folds: the state is that of one batch."""
    for path, schema in arriving(spark, sf, "late"):
        W.follow(spark, f"{path}/in", schema, f"{path}/state", projected, results, "v1", files_per_batch=100_000, fold_every=2)
    return flat(W.current(spark, f"{path}/state"))


@query(", s AS (SELECT CAST(d AS DATE) AS window_end FROM range(DATE '2024-01-14', DATE '2024-01-31', INTERVAL 1 DAY) r(d)) SELECT s.window_end, product, count(*) FILTER (date_diff('day', day, s.window_end) < 7) AS current, count(*) FILTER (date_diff('day', day, s.window_end) >= 7) AS past FROM s JOIN voc ON date_diff('day', voc.day, s.window_end) BETWEEN 0 AND 34 GROUP BY ALL", dates=("window_end",))
def r07_sliding(spark, sf):
    """Windows of every day as a stream whose days arrive in no order: after the last part they are those of a batch."""
    for path, schema in arriving(spark, sf, "sliding"):
        docs = projected(spark.readStream.schema(schema).parquet(f"{path}/in").dropDuplicates(["event_id"]))
        keep_updates(sliding_counts(docs, ["product"]), f"{path}/out", f"{path}/checkpoint")
    return newest_counts(spark, f"{path}/out", ["product"]).where(F.col("window_end").between("2024-01-14", "2024-01-30"))


@query(ARRIVED + ", l AS (SELECT part, count(*) FILTER (occurred_at < furthest) AS late FROM a JOIN m USING (part) GROUP BY part) SELECT part AS batch, documents, late FROM m JOIN l USING (part)")
def r12_arrivals(spark, sf):
    """New documents of each batch, and how many of them are older than what was there: counted, not dropped."""
    for path, schema in arriving(spark, sf, "arrivals"):
        W.follow(spark, f"{path}/in", schema, f"{path}/state", projected, results, "v1", files_per_batch=100_000)
    return W.arrivals(spark, f"{path}/state")


#: Alerts of keys whose worst rate of a day is known; every fifth by its hundredths has been dealt with on its day.
ALERTS = """, a AS (
  SELECT product || '-' || aspect || '-' || channel || '-' || strftime(day, '%Y%m%d') AS alert_id, product, aspect AS main_aspect, channel, day AS window_end, CAST(max(k) AS DOUBLE) / 100 AS rate FROM voc WHERE sentiment = -1 GROUP BY ALL
), s AS (
  SELECT *, CAST(round(rate * 100) AS INTEGER) % 5 = 0 AS resolved, row_number() OVER (PARTITION BY product, main_aspect, channel ORDER BY window_end) AS n FROM a
)"""


@query(ALERTS + """, r AS (
  SELECT * FROM (WITH RECURSIVE r AS (
    SELECT *, 'publish' AS decision, CAST(NULL AS VARCHAR) AS updates_alert_id, CASE WHEN NOT resolved THEN alert_id END AS la, CASE WHEN NOT resolved THEN window_end END AS lw, CASE WHEN NOT resolved THEN rate END AS lr FROM s WHERE n = 1
    UNION ALL
    SELECT x.* EXCLUDE (la0, lw0, lr0), CASE WHEN decision <> 'suppress' AND NOT resolved THEN alert_id ELSE la0 END, CASE WHEN decision <> 'suppress' AND NOT resolved THEN window_end ELSE lw0 END, CASE WHEN decision <> 'suppress' AND NOT resolved THEN rate ELSE lr0 END FROM (
      SELECT s.*, CASE WHEN lw IS NULL OR date_diff('day', lw, s.window_end) >= 7 THEN 'publish' WHEN s.rate - lr >= 0.05 - 1e-9 THEN 'update' ELSE 'suppress' END AS decision,
        CASE WHEN date_diff('day', lw, s.window_end) < 7 AND s.rate - lr >= 0.05 - 1e-9 THEN la END AS updates_alert_id, la AS la0, lw AS lw0, lr AS lr0
      FROM r JOIN s ON s.product = r.product AND s.main_aspect = r.main_aspect AND s.channel = r.channel AND s.n = r.n + 1) x
  ) SELECT * FROM r)
) SELECT alert_id, product, main_aspect, channel, window_end, rate, decision, updates_alert_id FROM r""", dates=("window_end",))
def r08_suppressed(spark, sf):
    """Alerts of all days as a stream in three parts; its state silences those that follow too soon without a jump."""
    path, docs = shared_path(spark, "suppressed"), documents(spark, sf).where("sentiment = -1")
    alerts = docs.groupBy("product", F.col("aspect").alias("main_aspect"), "channel", F.col("day").alias("window_end")).agg((F.max("k").cast("double") / 100).alias("rate"))
    alerts = alerts.withColumn("alert_id", F.concat_ws("-", "product", "main_aspect", "channel", F.date_format("window_end", "yyyyMMdd")))
    done = alerts.where(F.round(F.col("rate") * 100).cast("int") % 5 == 0).withColumn("resolved", F.lit(True))
    rows = alerts.withColumn("resolved", F.lit(False)).unionByName(done)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in (("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01")):
            rows.where((F.col("window_end") >= low) & (F.col("window_end") < high)).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
            suppressed(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUTPUT).parquet(f"{path}/out")


#: Two rows in ten thousand have an amount that is no number or are without a product.
DELIVERED = """, d AS (
  SELECT item_id, CASE WHEN source = 'cs' THEN 'inquiries' ELSE 'reviews' END AS table_name, k, sentiment, item_id % 10000 = 4321 AND source = 'cs' AS letters, item_id % 10000 = 1234 AS nameless FROM voc
)"""


@query(DELIVERED + """SELECT table_name, 'taken' AS outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS amount FROM d WHERE NOT letters AND NOT nameless GROUP BY table_name
UNION ALL SELECT 'negatives', 'taken', count(*), CAST(sum(k) AS BIGINT) FROM d WHERE sentiment = -1 AND NOT letters
UNION ALL SELECT table_name, CASE WHEN letters THEN '[CAST_INVALID_INPUT]' ELSE '[USER_RAISED_EXCEPTION] product is missing' END, count(*), CAST(0 AS BIGINT) FROM d WHERE letters OR nameless GROUP BY ALL
UNION ALL SELECT 'negatives', '[CAST_INVALID_INPUT]', count(*), CAST(0 AS BIGINT) FROM d WHERE letters AND sentiment = -1 HAVING count(*) > 0""")
def k06_tables(spark, sf):
    """Documents into three tables at once; rows with an amount that is no number or without product stand aside alone."""
    path, events = shared_path(spark, "tables"), spark.read.parquet(f"{sf}/events.parquet")

    def prepare(rows):
        docs, item = projected(rows), F.col("item_id")
        letters = (item % 10000 == 4321) & (F.col("source") == "cs")
        return docs.withColumns({"amount": F.when(letters, "n/a").otherwise(F.col("k").cast("string")), "product": F.when(item % 10000 == 1234, None).otherwise(F.col("product"))})

    number = F.col("amount").try_cast("int")
    amount = F.when(F.col("amount").isNotNull(), required(number, "amount")).alias("amount")
    letters, nameless = {"[CAST_INVALID_INPUT]": F.col("amount").isNotNull() & number.isNull()}, {"[USER_RAISED_EXCEPTION] product is missing": F.col("product").isNull()}
    columns = ("item_id", required(F.col("product"), "product").alias("product"), amount)
    tables = {
        "inquiries": Table(F.col("source") == "cs", columns, letters | nameless),
        "reviews": Table(F.col("source") == "review", columns, letters | nameless),
        "negatives": Table(F.col("sentiment") == -1, ("item_id", "aspect", amount), letters),
    }
    follow_tables(spark, f"{sf}/event[s].parquet", events.schema, path, prepare, tables, "item_id")
    out = None
    for name in tables:
        rows = read_table(spark, f"{path}/batches", name, "item_id long, amount int").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.lit(name).alias("table_name"), F.lit("taken").alias("outcome"), "n", "amount")
        out = rows if out is None else out.unionByName(rows)
    aside = read_table(spark, f"{path}/batches", "aside", "table_name string, key string, reason string")
    return out.unionByName(aside.groupBy("table_name", F.col("reason").alias("outcome")).agg(F.count("*").alias("n")).withColumn("amount", F.lit(0).cast("long")))


@query(RESULTS + """, f AS (SELECT item_id, k, sentiment, aspect, 1 + k % 4 AS attempts FROM x WHERE bad)
SELECT item_id, CASE WHEN attempts >= 3 THEN 'left' WHEN k % 27 = 0 THEN 'failed again' ELSE 'recovered' END AS outcome, CASE WHEN attempts >= 3 THEN attempts WHEN k % 27 = 0 THEN attempts + 1 ELSE 0 END AS attempts FROM f""")
def r04_retried(spark, sf):
    docs = documents(spark, sf)
    day = F.col("day")
    failures = docs.where("k % 9 = 0").select("item_id", F.lit("parse").alias("error"), (1 + F.col("k") % 4).cast("int").alias("attempts"), day.alias("first_failed_at"), day.alias("last_failed_at"))
    state = W.State.empty(spark)
    state = W.State(state.items, state.labels, failures, state.cursor)
    after = W.applied(state, results(W.retryable(failures, docs), "k % 27 = 0"), "v1", advance=False)
    before = failures.select("item_id", F.col("attempts").alias("before"))
    rows = before.join(after.failures, "item_id", "left")
    outcome = F.when(F.col("before") >= W.MAX_ATTEMPTS, "left").when(F.col("attempts").isNull(), "recovered").otherwise("failed again")
    return rows.select("item_id", outcome.alias("outcome"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query("SELECT item_id, CASE WHEN k % 4 IN (2, 3) THEN 'v2' WHEN k % 10 <> 3 AND k % 18 <> 0 THEN 'v2' WHEN k % 4 = 0 THEN 'none' ELSE 'v1' END AS version FROM voc WHERE k % 9 <> 4")
def r05_backfilled(spark, sf):
    """Documents of other versions are labelled again; those that fail keep their version, blank ones are left."""
    docs = documents(spark, sf).withColumn("content", F.when(F.col("k") % 10 == 3, " ").otherwise(F.col("aspect")))
    version = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, "v1").otherwise("v2")
    empty = W.State.empty(spark)
    state = W.State(docs.where("k % 9 <> 4").select("item_id", version.alias("version")), empty.labels, empty.failures, empty.cursor)
    after = W.applied(state, results(W.stale(state.items, docs, "v2"), "k % 18 = 0"), "v2", advance=False)
    return after.items.select("item_id", F.coalesce("version", F.lit("none")).alias("version"))


@query(RESULTS + "SELECT product, k AS batch, count(*) AS documents, count(*) FILTER (k % 3 = 0) AS failed, count(*) FILTER (k % 3 = 0 AND call_failed) AS calls, count(*) = count(*) FILTER (k % 3 = 0) AND count(*) FILTER (k % 3 = 0 AND call_failed) > 0 AS halt FROM (SELECT * REPLACE (k % 3 = 0 AND k % 2 = 0 AS call_failed) FROM x) GROUP BY ALL")
def r06_halts(spark, sf):
    return W.halts(results(documents(spark, sf), "k % 3 = 0").withColumn("batch", F.col("k")), ["product", "batch"])


@query(RESULTS + "SELECT item_id, CASE WHEN error = 'parse' THEN 'aside' ELSE 'again' END AS route FROM x WHERE bad")
def r10_dispatched(spark, sf):
    return W.dispatched(results(documents(spark, sf)).where("labels IS NULL"), ["parse", "schema"]).select("item_id", "route")
