"""Queries of lookups, evidence and audits of alerts against windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori import constants as C
from sori.operators import joins as J
from sori.plans.registry import query
from sori.sources.voc import documents

#: Alerts: slots with two negatives or more on a day. Windows: five days from the first negative with k % 10 = 0 (counted) or 1 (ignored).
AUDIT = """, al AS (
  SELECT product || '/' || aspect || '/' || source || '/' || day AS alert_id, product, aspect, source, day, list_sort(list(channel)) AS channels
  FROM (SELECT product, aspect, source, day, channel FROM voc WHERE sentiment = -1 GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL
), tr AS (
  SELECT product, aspect, channel, source, min(day) AS start, CAST(min(day) + INTERVAL 4 DAY AS DATE) AS fin FROM voc WHERE sentiment = -1 AND k % 10 = 0 GROUP BY ALL
), ig AS (
  SELECT product, aspect, channel, source, min(day) AS start, CAST(min(day) + INTERVAL 4 DAY AS DATE) AS fin FROM voc WHERE sentiment = -1 AND k % 10 = 1 GROUP BY ALL
)
"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    slots = documents(spark, sf).where("sentiment = -1").groupBy("product", "aspect", "source", "day", "channel").agg(F.count("*").alias("n")).where("n >= 2")
    rows = slots.groupBy("product", "aspect", "source", "day").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    return rows.withColumn("alert_id", F.concat_ws("/", "product", "aspect", "source", F.col("day").cast("string")))


def windows(spark: SparkSession, sf: str, k: int) -> DataFrame:
    rows = documents(spark, sf).where((F.col("sentiment") == -1) & (F.col("k") % 10 == k))
    return rows.groupBy(*J.SLOT).agg(F.min("day").alias("start")).withColumn("end", F.date_add("start", 4))


def _name_lookup(agg: str) -> str:
    return f"SELECT p_brand AS brand, p_size AS size, {agg}(p_name, p_partkey) AS name FROM part GROUP BY ALL"


@query(", x AS (SELECT 1) " + _name_lookup("max_by"))
def j06_lookup_last(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("name"), "p_partkey")
    return J.lookup(part, ["brand", "size"], "p_partkey", last=True).select("brand", "size", "name")


@query(", x AS (SELECT 1) " + _name_lookup("min_by"))
def j07_lookup_first(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_name").alias("name"), "p_partkey")
    return J.lookup(part, ["brand", "size"], "p_partkey").select("brand", "size", "name")


@query(", g AS (SELECT DISTINCT product, channel, 'G' || product AS grp FROM voc WHERE product <> 'P012') SELECT channel, source, count(*) AS n, count(*) FILTER (grp IS NULL) AS misses FROM voc LEFT JOIN g USING (product, channel) GROUP BY ALL")
def j08_group_misses(spark, sf):
    docs = documents(spark, sf)
    groups = docs.where("product <> 'P012'").select("product", "channel", F.concat(F.lit("G"), "product").alias("grp")).distinct()
    return docs.join(groups, ["product", "channel"], "left").groupBy("channel", "source").agg(F.count("*").alias("n"), F.count_if(F.col("grp").isNull()).alias("misses"))


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND trim(d.text) <> '' AND d.lang = 'en')")
def j11_orphans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where((F.trim("text") != "") & (F.col("lang") == "en"))
    return spark.read.parquet(f"{sf}/labels.parquet").join(docs, "doc_id", "left_anti").select("doc_id")


@query(""", l AS (SELECT item_id AS alert_id, unnest([item_id + 1, item_id, item_id + 1, -1, item_id + 2]) AS id, unnest([0, 1, 2, 3, 4]) AS place FROM voc WHERE sentiment = -1),
f AS (SELECT alert_id, id, min(place) AS place FROM l GROUP BY ALL)
SELECT alert_id, v.item_id, row_number() OVER (PARTITION BY alert_id ORDER BY place) - 1 AS pos FROM f JOIN voc v ON v.item_id = f.id WHERE v.aspect <> '기타'""")
def j12_evidence(spark, sf):
    docs = documents(spark, sf)
    lists = docs.where("sentiment = -1").select(F.col("item_id").alias("alert_id"), F.array(F.col("item_id") + 1, "item_id", F.col("item_id") + 1, F.lit(-1).cast("long"), F.col("item_id") + 2).alias("ids"))
    content = docs.select("item_id", F.when(F.col("aspect") != "기타", F.col("aspect")).otherwise(" ").alias("content"))
    return J.evidence(lists, content).select("alert_id", "item_id", F.col("pos").cast("long").alias("pos"))


@query(AUDIT + ", ad AS (SELECT DISTINCT a.product, a.aspect, c AS channel, CAST(s.g AS DATE) AS day FROM al a, unnest(a.channels) t(c), unnest(generate_series(CAST(a.day AS TIMESTAMP) - INTERVAL 6 DAY, CAST(a.day AS TIMESTAMP), INTERVAL 1 DAY)) s(g) WHERE c <> 'ZIGZAG') SELECT product, aspect, channel, day FROM ad", dates=("day",))
def d18_alert_days(spark, sf):
    rows = alerts(spark, sf).select("product", "aspect", F.explode("channels").alias("c"), F.date_sub("day", 6).alias("window_start"), F.col("day").alias("window_end"))
    return J.alert_days(rows.withColumn("channel", F.when(F.col("c") == "ZIGZAG", "ALL").otherwise(F.col("c"))))


@query(", c AS (SELECT item_id, 'cached' AS aspect FROM voc WHERE k % 3 <> 0) SELECT product, coalesce(c.aspect, v.aspect) AS aspect, count(*) AS n, avg(CASE WHEN c.item_id IS NULL THEN 0.0 ELSE 1.0 END) AS coverage FROM voc v LEFT JOIN c USING (item_id) GROUP BY ALL")
def j19_overlay(spark, sf):
    docs = documents(spark, sf)
    rows = J.overlay(docs, docs.where("k % 3 <> 0").select("item_id", F.lit("cached").alias("aspect")), "item_id", "aspect")
    return rows.groupBy("product", "aspect").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("coverage"))


KINDS = AUDIT + """, sp AS (SELECT *, TRUE AS scored FROM tr UNION ALL SELECT *, FALSE FROM ig
), kinds AS (
  SELECT alert_id, CASE min(CASE WHEN scored AND a.day BETWEEN start AND fin THEN 0 WHEN scored AND a.day > fin AND a.day <= fin + INTERVAL 6 DAY THEN 1
    WHEN NOT scored AND a.day >= start AND a.day <= fin + INTERVAL 6 DAY THEN 2 ELSE 3 END) WHEN 0 THEN 'true' WHEN 1 THEN 'echo' WHEN 2 THEN 'ignored' ELSE 'false' END AS kind
  FROM (SELECT alert_id, product, aspect, source, day, unnest(channels) AS channel FROM al) a LEFT JOIN sp USING (product, aspect, source, channel) GROUP BY alert_id
)
"""


@query(KINDS + "SELECT alert_id, kind FROM kinds")
def j20_alert_kinds(spark, sf):
    return J.alert_kinds(alerts(spark, sf), windows(spark, sf, 0), windows(spark, sf, 1))


@query(KINDS + "SELECT count(*) AS published, count(*) FILTER (kind = 'true') AS n_true, count(*) FILTER (kind = 'echo') AS n_echo, count(*) FILTER (kind = 'ignored') AS n_ignored, count(*) FILTER (kind = 'false') AS n_false, round(count(*) FILTER (kind = 'false') / count(*) FILTER (kind <> 'ignored'), 9) AS false_ratio FROM kinds")
def e16_scorecard(spark, sf):
    return J.scorecard(J.alert_kinds(alerts(spark, sf), windows(spark, sf, 0), windows(spark, sf, 1))).withColumn("false_ratio", F.round("false_ratio", 9))


@query(AUDIT + "SELECT alert_id, channel, date_diff('day', greatest(day - INTERVAL 6 DAY, start), least(day, fin)) + 1 AS overlap FROM al JOIN tr USING (product, aspect, source) WHERE day - INTERVAL 6 DAY <= fin AND start <= day")
def j21_overlaps(spark, sf):
    return J.overlapping(alerts(spark, sf), windows(spark, sf, 0), ["product", "aspect", "source"]).select("alert_id", "channel", F.col("overlap").cast("long").alias("overlap"))


@query(AUDIT + """, p AS (
  SELECT alert_id, tr.channel AS t_channel, start, CASE WHEN start IS NULL THEN 4 WHEN list_contains(channels, tr.channel) AND day < start THEN 0 WHEN day < start THEN 1 WHEN list_contains(channels, tr.channel) THEN 2 ELSE 3 END AS place,
    date_diff('day', day, start) AS ds, date_diff('day', fin, day) AS de
  FROM al LEFT JOIN tr USING (product, aspect, source)
), b AS (SELECT *, CASE WHEN place < 2 THEN ds WHEN place = 2 THEN abs(de) ELSE abs(ds) END AS away FROM p)
SELECT alert_id, ['early_same_channel', 'early_other_channel', 'after_same_channel', 'other_channel_only', 'none'][place + 1] AS relation, start AS nearest_start, t_channel AS nearest_channel, away AS days_away
FROM b QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY place, away, start, t_channel) = 1""", dates=("nearest_start",))
def j22_nearest_windows(spark, sf):
    return J.nearest_windows(alerts(spark, sf), windows(spark, sf, 0)).withColumn("days_away", F.col("days_away").cast("long"))


@query(AUDIT + "SELECT DISTINCT a.alert_id FROM al a JOIN al b ON a.product = b.product AND a.aspect = b.aspect AND a.source <> b.source AND abs(date_diff('day', a.day, b.day)) <= 1 AND list_has_any(a.channels, b.channels) WHERE a.source = 'cs'")
def j23_matched_alerts(spark, sf):
    rows = alerts(spark, sf)
    return J.matched_alerts(rows.where("source = 'cs'"), rows.where("source = 'review'").withColumn("source", F.lit("cs")))


@query("SELECT key, CASE WHEN b IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT c_custkey AS key, TRUE AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey * 2 AS key, TRUE AS b FROM orders) USING (key) WHERE a IS NULL OR b IS NULL")
def j25_differences(spark, sf):
    a = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return J.differences(a, spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") * 2).alias("key")), ["key"])


@query(", m AS (SELECT product, day, item_id, k % 7 = 0 AS hit, max(k % 7 = 0) OVER (PARTITION BY product, day) AS any_hit FROM voc) SELECT product, day, item_id FROM m WHERE hit OR NOT any_hit QUALIFY row_number() OVER (PARTITION BY product, day ORDER BY item_id) <= 5", dates=("day",))
def j29_preferred(spark, sf):
    rows = documents(spark, sf).withColumn("hit", F.col("k") % 7 == 0)
    return J.preferred(rows, ["product", "day"], "hit", "item_id", 5).select("product", "day", "item_id")


#: Results of each source by product and channel, as given by counts.
RESULTS = f""", rs AS (SELECT product, channel, source, CASE WHEN count(*) % 3 = 0 THEN '{C.GLOBAL}' ELSE '{C.BIASED}' END AS verdict, CASE WHEN count(*) % 2 = 0 THEN '{C.LOW}' ELSE '{C.MEDIUM}' END AS confidence, count(*) % 5 <> 0 AS fired FROM voc GROUP BY ALL
), both_ AS (SELECT product, channel, c.verdict AS cv, c.confidence AS cc, c.fired AS cf, r.confidence AS rc, r.fired AS rf FROM (SELECT * FROM rs WHERE source = 'cs') c FULL JOIN (SELECT * FROM rs WHERE source = 'review') r USING (product, channel))
"""


@query(RESULTS + f"""SELECT product, channel, CASE WHEN cf THEN 'cs' WHEN rf THEN 'review' END AS primary_source,
  CASE WHEN cf AND rf THEN CASE WHEN cv <> '{C.BIASED}' THEN cc WHEN cc = '{C.LOW}' THEN '{C.MEDIUM}' ELSE '{C.HIGH}' END WHEN cf THEN cc WHEN rf THEN rc END AS confidence,
  CASE WHEN cf AND rf THEN '{C.READINGS['both']}' WHEN cf THEN '{C.READINGS['cs']}' WHEN rf THEN '{C.READINGS['review']}' END AS reading, cf AS cs_signal, rf AS review_signal FROM both_""")
def d10_combined(spark, sf):
    n = F.col("n")
    rows = documents(spark, sf).groupBy("product", "channel", "source").agg(F.count("*").alias("n"))
    rows = rows.select("product", "channel", "source", F.when(n % 3 == 0, C.GLOBAL).otherwise(C.BIASED).alias("verdict"), F.when(n % 2 == 0, C.LOW).otherwise(C.MEDIUM).alias("confidence"), (n % 5 != 0).alias("fired"))
    return J.combined(rows.where("source = 'cs'"), rows.where("source = 'review'"))


@query("""SELECT product, channel, CASE WHEN cn > 0 THEN cneg * 4 > cn END AS cs_signal, CASE WHEN rn > 0 THEN rneg * 4 > rn END AS review_signal FROM (
  SELECT product, channel, count(*) FILTER (source = 'cs') AS cn, count(*) FILTER (source = 'cs' AND sentiment = -1) AS cneg, count(*) FILTER (source = 'review') AS rn, count(*) FILTER (source = 'review' AND sentiment = -1) AS rneg
  FROM voc WHERE NOT (source = 'cs' AND product < 'P004') AND NOT (source = 'review' AND product > 'P009') GROUP BY product, channel)""")
def d12_signals(spark, sf):
    """Whether each source fired: true, false, or null where it was not evaluated (products that only one source speaks of)."""
    docs = documents(spark, sf).where("NOT (source = 'cs' AND product < 'P004') AND NOT (source = 'review' AND product > 'P009')")
    fired = F.count_if(F.col("sentiment") == -1) * 4 > F.count("*")
    rows = docs.groupBy("product", "channel", "source").agg(fired.alias("fired")).withColumns({"verdict": F.lit(C.GLOBAL), "confidence": F.lit(C.LOW)})
    return J.combined(rows.where("source = 'cs'"), rows.where("source = 'review'")).select("product", "channel", "cs_signal", "review_signal")
