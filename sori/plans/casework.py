"""Queries of planned cases, texts, dates and checks of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import stats, text, times
from sori.operators import cases as K
from sori.operators import validation as V
from sori.plans.lookups import count_if, rows_n, table
from sori.plans.registry import END, query
from sori.sources.voc import documents

#: Case rows: k < 3 on inquiries and reviews of a slot and attribute; the window is of five days, numbered so that END is day 60.
CONFIG = """, cf AS (
  SELECT DISTINCT product, channel, source, aspect, 60 - date_diff('day', day, DATE '2024-01-30') AS start_day, 64 - date_diff('day', day, DATE '2024-01-30') AS end_day, k = 0 AS intended FROM voc WHERE k < 3 AND sentiment = -1
), cw AS (
  SELECT product, channel, source, start_day, end_day, array_to_string(list_sort(list(DISTINCT aspect)), ',') AS aspects, bool_or(intended) AS hot FROM cf GROUP BY ALL
)
"""


def config(spark: SparkSession, sf: str) -> DataFrame:
    n = times.day_number(F.col("day"), END)
    rows = documents(spark, sf).where("k < 3 AND sentiment = -1")
    return rows.select("product", "channel", "source", "aspect", n.alias("start_day"), (n + 4).alias("end_day"), (F.col("k") == 0).alias("intended")).distinct()


@query(CONFIG + "SELECT * FROM cw")
def m03_case_windows(spark, sf):
    return K.case_windows(config(spark, sf)).withColumn("aspects", F.array_join("aspects", ","))


@query(CONFIG + "SELECT DISTINCT product, channel, source, unnest(range(greatest(1, start_day - 28), least(60, end_day) + 1)) AS n FROM cw")
def m04_covered_days(spark, sf):
    return K.covered_days(K.case_windows(config(spark, sf))).withColumn("n", F.col("n").cast("long"))


@query(CONFIG + "SELECT product, channel, source FROM cw WHERE hot UNION SELECT product, channel, 'review' FROM cw WHERE hot AND source = 'cs'")
def m05_hot_channels(spark, sf):
    return K.hot_channels(K.case_windows(config(spark, sf)))


@query(""", cs AS (SELECT product, source, max(day) AS fin FROM voc WHERE sentiment = -1 GROUP BY ALL), nd AS (SELECT *, unnest([1, 2, 3]) AS need FROM cs)
SELECT need, count(*) FILTER (k % 6 = 1) AS missing, count(*) AS total FROM nd JOIN voc ON voc.product = nd.product AND voc.source = nd.source AND date_diff('day', voc.day, nd.fin) BETWEEN 0 AND 5 + need GROUP BY need""")
def m09_prediction_coverage(spark, sf):
    docs = documents(spark, sf).withColumn("predicted", F.col("k") % 6 != 1)
    ends = docs.where("sentiment = -1").groupBy("product", "source").agg(F.max("day").alias("end"))
    return K.missing_predictions(ends, docs)


@query(""", cs AS (SELECT product, source, max(day) AS fin FROM voc WHERE sentiment = -1 GROUP BY ALL)
SELECT v.product, v.source, count(*) AS n FROM cs JOIN voc v ON v.product = cs.product AND v.source = cs.source AND v.day BETWEEN cs.fin - INTERVAL 8 DAY AND cs.fin GROUP BY ALL""")
def m11_widened_windows(spark, sf):
    docs = documents(spark, sf)
    ends = docs.where("sentiment = -1").groupBy("product", "source").agg(F.max("day").alias("end"))
    days = ends.withColumn("day", F.explode(F.sequence(F.date_sub("end", C.CURRENT_DAYS + 1), F.col("end"))))
    daily = docs.groupBy("product", "source", "day").agg(rows_n())
    return days.join(daily, ["product", "source", "day"]).groupBy("product", "source").agg(F.sum("n").alias("n"))


@query(", a AS (SELECT product, aspect, channel, count(*) AS n FROM voc WHERE sentiment = -1 GROUP BY ALL) SELECT product, aspect, channel, row_number() OVER (PARTITION BY product ORDER BY CASE WHEN aspect = '색상' THEN 0 ELSE 1 END, n DESC, aspect, channel) AS rank FROM a")
def m15_expected_first(spark, sf):
    rows = documents(spark, sf).where("sentiment = -1").groupBy("product", "aspect", "channel").agg(rows_n())
    order = Window.partitionBy("product").orderBy(F.when(F.col("aspect") == "색상", 0).otherwise(1), F.desc("n"), "aspect", "channel")
    return rows.select("product", "aspect", "channel", F.row_number().over(order).alias("rank"))


@query("SELECT product, aspect, concat(aspect, ' ', CAST(count(*) AS VARCHAR), '건 중 부정 ', CAST(count(*) FILTER (sentiment = -1) AS VARCHAR), '건') AS sentence FROM voc GROUP BY product, aspect")
def m18_sentences(spark, sf):
    rows = documents(spark, sf).groupBy("product", "aspect").agg(rows_n(), count_if("sentiment = -1").alias("neg"))
    return rows.select("product", "aspect", F.format_string("%s %d건 중 부정 %d건", "aspect", "n", "neg").alias("sentence"))


@query(f"""SELECT coalesce(CASE WHEN aspect IN ('파손', '기타') THEN 'gate_closed' WHEN k % 5 = 0 THEN 'no_evidence' WHEN k % 7 = 1 THEN 'error' WHEN k % 3 = 0 THEN 'routed_without_evidence' END, 'proposed') AS outcome, count(*) AS n FROM voc GROUP BY ALL""")
def d22_outcomes(spark, sf):
    action = F.when(F.col("aspect").isin("파손", "기타"), C.ACTIONS["channel"]).otherwise(C.ACTIONS["recommend"])
    k = F.col("k")
    why = K.outcome(action, k % 5, k % 3, k % 7 == 1)
    return documents(spark, sf).groupBy(F.coalesce(why, F.lit("proposed")).alias("outcome")).agg(rows_n())


@query(", x AS (SELECT 1) SELECT conv_id, turn, array_to_string(list_filter([text, ' ', upper(text), concat('> ', text)], lambda t: trim(t) <> '' AND contains(t, substr(text, 1, 12)))[1:5], '|') AS cited FROM conversations")
def d23_citations(spark, sf):
    texts = F.array("text", F.lit(" "), F.upper("text"), F.concat(F.lit("> "), "text"))
    rows = table(spark, sf, "conversations")
    return rows.select("conv_id", "turn", F.array_join(K.citations(texts, F.substring("text", 1, 12)), "|").alias("cited"))


@query("SELECT item_id, CASE WHEN k % 4 <> 0 THEN CASE k % 3 WHEN 0 THEN 'edited' ELSE aspect END END AS text FROM voc")
def d24_reviewed_texts(spark, sf):
    k = F.col("k")
    status = F.when(k % 4 == 0, "rejected").when(k % 4 == 1, "approved")
    edited = F.when(k % 3 == 0, " edited ").when(k % 3 == 1, "  ")
    return documents(spark, sf).select("item_id", K.reviewed_text(status, edited, F.col("aspect")).alias("text"))


@query(""", al AS (SELECT item_id AS alert_id, product, aspect, source, channel, k % 2 = 0 AS oracle FROM voc WHERE sentiment = -1 AND k % 5 = 0),
cs AS (SELECT DISTINCT product, aspect, source, channel, k % 4 AS overlap, k % 3 = 0 AS future, k % 2 = 0 AS scored FROM voc WHERE k BETWEEN 1 AND 6 AND product < 'P009' AND day = DATE '2024-01-20'),
m AS (SELECT al.*, cs.future, al.aspect = cs.aspect AS sa, al.source = cs.source AS ss, al.channel = cs.channel AS sc, overlap > 0 AS near, scored FROM al LEFT JOIN cs ON al.product = cs.product),
b AS (SELECT alert_id, bool_or(oracle) AS oracle, bool_or(sa AND ss AND sc AND near AND scored) AS c1, bool_or(sa AND ss AND sc AND near) AS c2, bool_or(sa AND NOT ss AND near) AS c3, bool_or(NOT sa AND near) AS c4, bool_or(sa AND ss AND sc AND future) AS f FROM m GROUP BY alert_id)
SELECT alert_id, CASE WHEN c1 THEN 'planned_negative' WHEN c2 THEN 'not_scored' WHEN c3 THEN 'other_source' WHEN c4 THEN 'other_aspect' WHEN NOT oracle THEN 'classifier_only' WHEN f THEN 'future_case' ELSE 'unexplained' END AS category FROM b""")
def d27_false_alert_categories(spark, sf):
    docs, k = documents(spark, sf), F.col("k")
    alerts = docs.where("sentiment = -1 AND k % 5 = 0").select(F.col("item_id").alias("alert_id"), "product", "aspect", "source", "channel", (k % 2 == 0).alias("oracle"))
    planned = docs.where("k BETWEEN 1 AND 6 AND product < 'P009'").where(F.col("day") == "2024-01-20")
    planned = planned.select("product", "aspect", "source", "channel", (k % 4).alias("overlap"), (k % 3 == 0).alias("future"), (k % 2 == 0).alias("scored")).distinct()
    return K.first_per_alert(alerts, planned).select("alert_id", "category")


@query(f""", f AS (SELECT product, aspect, channel, CASE WHEN max(k) >= 99 AND min(k) < 2 THEN count(*) FILTER (sentiment = -1) * 5 > count(*) END AS flag FROM voc GROUP BY ALL),
g AS (SELECT product, aspect, count(*) AS n, count(flag) AS decided, count(*) FILTER (flag) AS fired FROM f GROUP BY ALL)
SELECT product, aspect, CASE WHEN n = 3 AND decided = 3 THEN CASE fired WHEN 0 THEN '{C.NORMAL}' WHEN 3 THEN '{C.GLOBAL}' ELSE '{C.BIASED}' END END AS verdict FROM g""")
def d28_gold_verdicts(spark, sf):
    rows = documents(spark, sf).groupBy("product", "aspect", "channel").agg(rows_n(), count_if("sentiment = -1").alias("neg"), F.max("k").alias("high"), F.min("k").alias("low"))
    flag = F.when((F.col("high") >= 99) & (F.col("low") < 2), F.col("neg") * 5 > F.col("n"))
    # a struct around each flag, since collected lists leave nulls out; three channels at most
    flags = rows.groupBy("product", "aspect").agg(F.collect_list(F.struct(flag.alias("f"))).alias("flags"))
    return flags.select("product", "aspect", K.gold_verdict(F.transform("flags", lambda x: x["f"])).alias("verdict"))


@query(", p AS (SELECT unnest(['click', 'purchase']) AS event_type, unnest([180, 30]) AS days) SELECT event_type, coalesce(p.days, 7) AS days, count(*) AS n FROM events LEFT JOIN p USING (event_type) GROUP BY ALL")
def d29_storage_policy(spark, sf):
    policy = F.coalesce(F.element_at(F.create_map(F.lit("click"), F.lit(180), F.lit("purchase"), F.lit(30)), F.col("event_type")), F.lit(7))
    return table(spark, sf, "events").groupBy("event_type", policy.alias("days")).agg(rows_n())


@query("SELECT CAST(occurred_at + INTERVAL 9 HOUR AS DATE) AS day, channel, count(*) AS n FROM voc GROUP BY ALL", dates=("day",))
def y01_local_days(spark, sf):
    return documents(spark, sf).groupBy(times.local_time(F.col("occurred_at")).cast("date").alias("day"), "channel").agg(rows_n())


@query("SELECT day, date_diff('day', DATE '1970-01-01', day) + 719163 AS n, day AS back, 60 - date_diff('day', day, DATE '2024-01-30') AS number, isodow(day) >= 6 AS weekend, count(*) AS documents FROM voc GROUP BY day", dates=("day", "back"))
def y02_day_numbers(spark, sf):
    rows = documents(spark, sf).groupBy("day").agg(F.count("*").alias("documents"))
    n = times.ordinal(F.col("day"))
    return rows.select("day", n.alias("n"), times.from_ordinal(n).alias("back"), times.day_number(F.col("day"), END).alias("number"), times.weekend(F.col("day")).alias("weekend"), "documents")


@query(", x AS (SELECT 1) SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS first, last_day(o_orderdate) AS last, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE) AS before, count(*) AS n FROM orders GROUP BY ALL", dates=("first", "last", "before"))
def y03_months(spark, sf):
    first, last, before = times.month_bounds(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").groupBy(first.alias("first"), last.alias("last"), before.alias("before")).agg(rows_n())


@query(", x AS (SELECT 1) SELECT role, count(*) FILTER (contains(text, '?') OR contains(text, 'please')) AS hits, count(*) AS n FROM conversations GROUP BY role")
def x06_markers(spark, sf):
    hit = text.any_marker(F.col("text"), ("?", "please"))
    return table(spark, sf, "conversations").groupBy("role").agg(F.count_if(hit).alias("hits"), rows_n())


@query("SELECT item_id, CASE WHEN k % 10 >= 5 THEN aspect ELSE '보통' END AS cause FROM voc")
def x15_top_weight(spark, sf):
    weights = F.concat(F.col("aspect"), F.lit(":0."), (F.col("k") % 10).cast("string"), F.lit(", 보통:0.5,bad,worse:x"))
    return documents(spark, sf).select("item_id", text.heaviest(weights).alias("cause"))


@query("SELECT item_id, CASE WHEN k % 2 = 0 THEN concat(aspect, ',', '불량') ELSE aspect END AS words FROM voc")
def x16_keywords(spark, sf):
    said = F.concat_ws(" ", F.col("aspect"), "product", F.lit("안"), F.when(F.col("k") % 2 == 0, "불량!"), F.col("aspect"))
    return documents(spark, sf).select("item_id", F.array_join(text.keywords(said), ",").alias("words"))


@query("SELECT item_id, concat(channel, ',', aspect) AS parts FROM voc")
def x19_parsed_sets(spark, sf):
    raw = F.concat(F.col("channel"), F.lit("| ,"), F.col("aspect"), F.lit(", "), F.col("channel"))
    return documents(spark, sf).select("item_id", F.array_join(text.parsed_set(raw), ",").alias("parts"))


@query("SELECT lang, CAST(sum(CAST(concat('0x', substr(sha256(concat(doc_id, chr(31), coalesce(text, ''))), 1, 8)) AS BIGINT)) AS BIGINT) AS fingerprint, count(*) AS n FROM documents GROUP BY lang")
def x20_fingerprints(spark, sf):
    """Sums of row digests: any order gives the same, and rows are combined before they are exchanged."""
    rows = table(spark, sf, "documents")
    return rows.groupBy("lang").agg(F.sum(text.fingerprint(F.col("doc_id"), F.coalesce("text", F.lit("")))).alias("fingerprint"), rows_n())


@query("SELECT doc_id FROM documents WHERE doc_id % 11 = 0 AND text <> upper(text)")
def x21_drifted_texts(spark, sf):
    now = table(spark, sf, "documents").select("doc_id", "text")
    kept = now.select("doc_id", F.when(F.col("doc_id") % 11 == 0, F.upper("text")).otherwise(F.col("text")).alias("before"))
    return now.join(kept, "doc_id").where("text <> before").select("doc_id")


@query("SELECT product, count(*) AS items, count(*) FILTER (k % 3 = 0) AS labels FROM voc GROUP BY product")
def z01_exploded_labels(spark, sf):
    labels = F.when(F.col("k") % 3 == 0, F.array("aspect")).otherwise(F.array().cast("array<string>"))
    rows = documents(spark, sf).select("product", F.explode_outer(labels).alias("aspect"))
    return rows.groupBy("product").agg(F.count("*").alias("items"), F.count("aspect").alias("labels"))


@query("SELECT item_id, CASE WHEN sentiment = -1 THEN aspect ELSE '' END AS negatives FROM voc")
def z02_negative_aspects(spark, sf):
    other = F.struct(F.lit("배송").alias("aspect"), F.lit(1).alias("sentiment"))
    labels = F.array(F.struct("aspect", "sentiment"), other)
    return documents(spark, sf).select("item_id", F.array_join(V.negative_aspects(labels), ",").alias("negatives"))


@query("SELECT source, count(*) AS n, count(*) FILTER (k % 6 IN (0, 3)) AS skipped FROM voc GROUP BY source")
def z09_parallel_labels(spark, sf):
    """Labels and sentiments of one text each, split and zipped; rows whose lengths differ are skipped."""
    names, marks = F.split(F.concat("aspect", F.lit("|배송")), r"\|"), F.split(F.when(F.col("k") % 3 == 0, "-1").otherwise("-1|1"), r"\|")
    rows = documents(spark, sf).withColumn("labels", F.when(F.size(names) == F.size(marks), F.arrays_zip(names, marks)))
    return rows.groupBy("source").agg(rows_n(), count_if("labels IS NULL").alias("skipped"))


@query("SELECT source, count(*) FILTER (k % 4 <> 0) AS covered, count(*) AS n FROM voc GROUP BY source")
def z12_cited_evidence(spark, sf):
    evidence, cited = F.array(F.col("item_id"), F.col("item_id") + 1), F.when(F.col("k") % 4 == 0, F.array(F.col("item_id") + 2)).otherwise(F.array("item_id"))
    return documents(spark, sf).groupBy("source").agg(F.count_if(F.size(F.array_except(cited, evidence)) == 0).alias("covered"), rows_n())


@query("SELECT label, count(*) AS n, round(avg(CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE 1.0 END), 9) AS hit_rate FROM embeddings WHERE label IS NOT NULL GROUP BY label")
def v03_exact_hits(spark, sf):
    """Rate at which ids are found under their own label in a store that lacks every third."""
    rows = table(spark, sf, "embeddings").select("vec_id", "label").where("label IS NOT NULL")
    store = rows.where("vec_id % 3 <> 0").select("vec_id", F.col("label").alias("found"))
    hit = F.coalesce(F.col("found") == F.col("label"), F.lit(False)).cast("double")
    return rows.join(store, "vec_id", "left").groupBy("label").agg(rows_n(), F.round(F.avg(hit), 9).alias("hit_rate"))


@query(", x AS (SELECT 1) SELECT coalesce(json_extract_string(props, '$.tenant'), 'none') AS tenant, count(*) AS n FROM events WHERE json_extract_string(props, '$.tenant') IS NULL GROUP BY ALL")
def v04_without_tenant(spark, sf):
    tenant = F.get_json_object("props", "$.tenant")
    return table(spark, sf, "events").where(tenant.isNull()).groupBy(F.coalesce(tenant, F.lit("none")).alias("tenant")).agg(rows_n())


@query("SELECT product, count(*) AS before, count(*) FILTER (k % 6 <> 2) AS after, round(avg(CASE WHEN k % 9 = 4 THEN 0.0 ELSE 1.0 END), 9) AS accuracy_before, round(avg(CASE WHEN k % 9 = 4 THEN 0.0 ELSE 1.0 END) FILTER (k % 6 <> 2), 9) AS accuracy_after FROM voc GROUP BY product")
def e04_leak_filter(spark, sf):
    """Accuracy with and without the items that examples of the prompt give away."""
    docs, right = documents(spark, sf), (F.col("k") % 9 != 4).cast("double")
    leaks = docs.where("k % 6 = 2").select("item_id", F.lit(True).alias("leak"))
    rows = docs.join(leaks, "item_id", "left").withColumn("right", right)
    clean = F.when(F.col("leak").isNull(), F.col("right"))
    return rows.groupBy("product").agg(F.count("*").alias("before"), F.count(clean).alias("after"), F.round(F.avg("right"), 9).alias("accuracy_before"), F.round(F.avg(clean), 9).alias("accuracy_after"))


@query("SELECT product, channel, source, count(*) AS planned, coalesce(nullif(count(*) FILTER (k % 50 = 3), 0), count(*)) AS used FROM voc GROUP BY ALL")
def e13_measured_slots(spark, sf):
    slot, docs = ["product", "channel", "source"], documents(spark, sf)
    measured = docs.where("k % 50 = 3").groupBy(*slot).agg(F.count("*").alias("measured"))
    return docs.groupBy(*slot).agg(F.count("*").alias("planned")).join(measured, slot, "left").select(*slot, "planned", F.coalesce("measured", "planned").alias("used"))


@query("SELECT k % 4 AS attempts, count(*) AS n, count(*) FILTER (k % 3 <> 0) AS cited, round(count(*) FILTER (k % 3 <> 0) / count(*), 9) AS coverage FROM voc WHERE sentiment = -1 GROUP BY ALL")
def e15_citation_coverage(spark, sf):
    rows = documents(spark, sf).where("sentiment = -1").withColumn("cited", (F.col("k") % 3 != 0).cast("int"))
    return rows.groupBy((F.col("k") % 4).alias("attempts")).agg(rows_n(), F.sum("cited").alias("cited"), F.round(F.avg("cited"), 9).alias("coverage"))


@query("SELECT v AS kind, count(*) AS n FROM (SELECT unnest(CASE k % 3 WHEN 0 THEN ['number'] WHEN 1 THEN ['label', 'number'] ELSE ['label'] END) AS v FROM voc WHERE sentiment = -1) GROUP BY ALL")
def e18_violation_kinds(spark, sf):
    k = F.col("k") % 3
    messages = F.when(k == 0, F.array(F.lit("number 7 unknown"), F.lit("number 8 unknown"))).when(k == 1, F.array(F.lit("label missing"), F.lit("number 9 unknown"))).otherwise(F.array(F.lit("label missing")))
    kinds = F.array_distinct(F.transform(messages, lambda m: F.when(F.contains(m, F.lit("number")), "number").otherwise("label")))
    return documents(spark, sf).where("sentiment = -1").select(F.explode(kinds).alias("kind")).groupBy("kind").agg(rows_n())


@query("""SELECT product, channel, n, round((c + 1.9208) / (n + 3.8416) - 1.96 * sqrt(c * (n - c) / n + 0.9604) / (n + 3.8416), 9) AS low FROM (SELECT product, channel, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (sentiment = -1) AS DOUBLE) AS c FROM voc GROUP BY ALL)""")
def t16_wilson_low(spark, sf):
    rows = documents(spark, sf).groupBy("product", "channel").agg(F.count("*").cast("double").alias("n"), count_if("sentiment = -1").cast("double").alias("c"))
    return rows.select("product", "channel", "n", F.round(stats.wilson(F.col("c"), F.col("n"))[0], 9).alias("low"))
