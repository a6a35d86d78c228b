"""Queries of planned cases against documents, reports' tables and notices, scores of cases, outputs that replace each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import times
from sori.operators import comparisons as X
from sori.operators import monthly as M
from sori.operators import outputs as O
from sori.operators import reports as R
from sori.plans import queries  # noqa: F401  (its SQL is used below)
from sori.plans.lookups import table
from sori.plans.registry import END, SQL, query
from sori.sources.shared import shared_path
from sori.sources.voc import documents

#: A case for each slot with negatives: it ends on their last day; its planned counts follow from their number.
CASES = """, cs AS (
  SELECT product || '/' || aspect || '/' || channel || '/' || source AS case_id, product, aspect, channel, source, max(day) AS window_end,
    count(*) AS cur_neg, count(*) * 4 AS cur_total, CAST(CASE WHEN aspect = '기타' THEN 0 ELSE sum(k % 3) END AS BIGINT) AS past_neg, count(*) * 10 AS past_total FROM voc WHERE sentiment = -1 GROUP BY product, aspect, channel, source
), guessed AS (SELECT * REPLACE (CASE WHEN k % 5 = 0 THEN 0 ELSE sentiment END AS sentiment) FROM voc
)"""


def cases(spark: SparkSession, sf: str) -> DataFrame:
    n, past = F.count("*"), F.when(F.col("aspect") == "기타", 0).otherwise(F.sum(F.col("k") % 3)).cast("long")
    rows = documents(spark, sf).where("sentiment = -1").groupBy("product", "aspect", "channel", "source")
    rows = rows.agg(F.max("day").alias("window_end"), n.alias("cur_neg"), (n * 4).alias("cur_total"), past.alias("past_neg"), (n * 10).alias("past_total"))
    return rows.withColumn("case_id", F.concat_ws("/", "product", "aspect", "channel", "source"))


def window_sql(label: str, docs: str) -> str:
    return f"""SELECT case_id, '{label}' AS label, count(*) FILTER (age < 7 AND own) AS cur_neg, count(*) FILTER (age < 7) AS cur_total, count(*) FILTER (age >= 7 AND own) AS past_neg, count(*) FILTER (age >= 7) AS past_total
    FROM (SELECT case_id, date_diff('day', d.day, window_end) AS age, d.aspect = cs.aspect AND d.sentiment = -1 AS own FROM cs LEFT JOIN {docs} d ON d.product = cs.product AND d.channel = cs.channel AND d.source = cs.source AND date_diff('day', d.day, window_end) BETWEEN 0 AND 34) GROUP BY case_id"""


@query(CASES + f""", u AS (
  SELECT case_id, 'config' AS label, cur_neg, cur_total, past_neg, past_total FROM cs UNION ALL {window_sql('gold', 'voc')} UNION ALL {window_sql('predicted', 'guessed')}
) SELECT *, round(CASE WHEN cur_total > 0 THEN cur_neg / cur_total ELSE 0 END - CASE WHEN past_total > 0 THEN past_neg / past_total ELSE 0 END, 9) AS delta FROM u""")
def m12_slot_comparison(spark, sf):
    """Each case's windows as planned, under gold labels and under predicted ones, side by side."""
    docs = documents(spark, sf)
    guessed = docs.withColumn("sentiment", F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("sentiment")))
    return X.compared_slots(cases(spark, sf), {"gold": docs, "predicted": guessed}).withColumn("delta", F.round("delta", 9))


@query(CASES + """, c AS (SELECT *, window_end - 6 AS ws FROM cs WHERE product < 'P007'
), o AS (
  SELECT case_id, count(d.item_id) FILTER (d.aspect = c.aspect AND d.sentiment = -1) AS observed_neg, count(d.item_id) AS observed_total FROM c LEFT JOIN voc d ON d.product = c.product AND d.channel = c.channel AND d.source = c.source AND date_diff('day', d.day, ws) BETWEEN 1 AND 28 GROUP BY case_id
), b AS (
  SELECT case_id, count(d.item_id) FILTER (d.aspect = c.aspect AND d.sentiment = -1) AS background_neg, count(d.item_id) AS background_total FROM c LEFT JOIN voc d ON d.channel = c.channel AND d.source = c.source AND d.product NOT IN (SELECT product FROM c) GROUP BY case_id
), r AS (
  SELECT case_id, observed_neg, observed_total, CASE WHEN observed_total > 0 THEN observed_neg / observed_total ELSE 0 END AS observed_rate, CAST(past_neg AS DOUBLE) / past_total AS config_rate, background_neg, background_total,
    CASE WHEN background_total > 0 THEN background_neg / background_total ELSE 0 END AS background_rate, CASE WHEN aspect = '기타' THEN 0.0 ELSE 0.1 END AS baseline FROM c JOIN o USING (case_id) JOIN b USING (case_id)
) SELECT case_id, observed_neg, observed_total, round(observed_rate, 9) AS observed_rate, round(config_rate, 9) AS config_rate, background_neg, background_total, round(background_rate, 9) AS background_rate,
  CASE WHEN background_rate > 0 THEN round(config_rate / background_rate, 2) END AS config_vs_background, abs(observed_rate - config_rate) < 0.00001 AS observed_matches, abs(config_rate - baseline) < 0.0001 AS config_matches FROM r""")
def m13_past_rates(spark, sf):
    """What was planned before each case against what is there, the attribute's baseline, and products without cases."""
    rate = F.when(F.col("aspect") == "기타", 0.0).otherwise(0.1)
    baselines = documents(spark, sf).select("aspect", "channel").distinct().withColumn("rate", rate)
    planned = cases(spark, sf).where("product < 'P007'").withColumn("window_start", F.date_sub("window_end", 6))
    rows = X.past_rates(planned, documents(spark, sf), baselines)
    return rows.withColumns({c: F.round(c, 9) for c in ("observed_rate", "config_rate", "background_rate")})


@query(CASES + """SELECT case_id, CASE WHEN date_diff('day', d.day, window_end) < 7 THEN 'current' ELSE 'past' END AS part, d.channel, d.source, d.aspect, count(*) AS n, count(*) FILTER (sentiment = -1) AS negatives
FROM cs JOIN voc d ON d.product = cs.product AND date_diff('day', d.day, window_end) BETWEEN 0 AND 34 GROUP BY ALL""")
def m14_case_context(spark, sf):
    return X.case_context(cases(spark, sf).select("case_id", "product", "window_end"), documents(spark, sf))


@query(""", m AS (
  SELECT product, aspect, count(*) AS n, count(*) FILTER (sentiment = 1) AS pos, count(*) FILTER (sentiment = 0) AS neu, count(*) FILTER (sentiment = -1) AS neg, list_position(['색상', '사이즈', '소재', '파손', '오배송', '기타'], aspect) AS place FROM voc GROUP BY product, aspect
), l AS (
  SELECT product, place, aspect || '|' || n || '|' || printf('%g', pos / n * 100) || '|' || printf('%g', neu / n * 100) || '|' || printf('%g', neg / n * 100) || '|' ||
    CASE WHEN place <= 3 THEN printf('%+g', (neg / n - CASE WHEN product > 'P006' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 100) || '|' || CASE WHEN neg / n - CASE WHEN product > 'P006' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END >= 0.03 THEN 'RISK' ELSE 'SAFE' END ELSE '-|-' END AS line FROM m
) SELECT product, string_agg(line, chr(10) ORDER BY place) AS aspect_table FROM l GROUP BY product""")
def m16_prompt_tables(spark, sf):
    """Shares in percent, drift (against half in the month before for some products) and status, by attribute."""
    ratios = M.sentiment_ratios(documents(spark, sf))
    before = ratios.where("product > 'P006'").select("product", "aspect", F.add_months("month", -1).alias("month"), F.lit(0).alias("pos"), F.lit(1).alias("neu"), F.lit(1).alias("neg"), F.lit(0.0).alias("pos_ratio"), F.lit(0.5).alias("neu_ratio"), F.lit(0.5).alias("neg_ratio"))
    drift = M.drift(ratios.unionByName(before)).where(F.col("aspect").isin(*C.SCOPE))
    rows = ratios.join(drift, ["product", "aspect", "month"], "left")
    rows = rows.select("product", "aspect", (F.col("pos") + F.col("neu") + F.col("neg")).alias("total"), *(F.col(f"{c}_ratio").alias(c) for c in ("pos", "neu", "neg")), "drift", "status")
    return R.aspect_table(rows, {a: i for i, a in enumerate(C.ASPECTS)})


@query(", dv AS (" + SQL["t10_divergence"] + """)
SELECT product, string_agg(channel_a || '-' || channel_b || '|' || (n_a + n_b) || '|' || CASE WHEN hold_reason IS NOT NULL THEN '-|보류' ELSE printf('%g', round(jsd, 2)) || '|' || CASE WHEN jsd < 0.1 THEN 'SAFE' WHEN jsd < 0.2 THEN 'CAUTION' ELSE 'CRISIS' END END, chr(10) ORDER BY channel_a, channel_b) AS pair_table FROM dv GROUP BY product""")
def m16_pair_tables(spark, sf):
    pairs = M.channel_divergence(documents(spark, sf)).withColumn("jsd", F.round("jsd", 9))
    return R.pair_table(pairs.withColumn("sample", F.col("n_a") + F.col("n_b")).withColumn("severity", M.severity(F.col("jsd"), F.lit(0.0), F.lit(True))))


@query("""
SELECT p_partkey, CASE WHEN length(whole) <= 30 THEN whole ELSE first || CASE WHEN shown > 1 THEN ', ' || b ELSE '' END || CASE WHEN shown > 2 THEN ', ' || c ELSE '' END || CASE WHEN shown < 3 THEN ' 외 ' || (3 - shown) || '개' ELSE '' END END AS notice
FROM (SELECT *, 1 + CAST(length(first) + 2 + length(b) <= room AS INTEGER) + CAST(length(first) + 4 + length(b) + length(c) <= room AS INTEGER) AS shown
FROM (SELECT *, CASE WHEN length(a) <= room THEN a ELSE substr(a, 1, room - length(code) - 1) || '…' || code END AS first
FROM (SELECT *, a || ', ' || b || ', ' || c AS whole, 30 - length(' 외 3개') AS room
FROM (SELECT p_partkey, p_name || '(P' || p_partkey || ')' AS a, '(P' || p_partkey || ')' AS code, p_brand AS b, p_type AS c FROM part))))""")
def d30_notices(spark, sf):
    labels = F.array(F.concat("p_name", F.lit("(P"), F.col("p_partkey").cast("string"), F.lit(")")), "p_brand", "p_type")
    return table(spark, sf, "part").select("p_partkey", R.notice(labels, 30).alias("notice"))


@query(f""", al AS (
  SELECT item_id AS alert_id, product, aspect, source, CASE WHEN k % 8 = 0 THEN ['COUPANG', 'NAVER'] ELSE [channel] END AS channels, 60 - date_diff('day', day, DATE '{END}') AS d FROM voc WHERE sentiment = -1
), wn AS (
  SELECT DISTINCT product, aspect, source, channel, 60 - date_diff('day', day, DATE '{END}') AS s, 62 - date_diff('day', day, DATE '{END}') AS e FROM voc WHERE sentiment = -1 AND k = 21 AND product > 'P002'
), ig AS (
  SELECT DISTINCT product, aspect, source, channel, 60 - date_diff('day', day, DATE '{END}') AS s, 61 - date_diff('day', day, DATE '{END}') AS e FROM voc WHERE sentiment = -1 AND k = 23
), j AS (
  SELECT al.*, wn.s, wn.e, wn.channel AS wc FROM al LEFT JOIN wn USING (product, aspect, source)
), f AS (
  SELECT alert_id, count(wc) AS cases, arg_min(d < s, s) FILTER (list_contains(channels, wc) AND (d < s OR d > e)) AS early FROM j GROUP BY alert_id
), x AS (
  SELECT DISTINCT alert_id FROM (SELECT * EXCLUDE (channels), unnest(channels) AS channel FROM al) JOIN ig USING (product, aspect, source, channel) WHERE d BETWEEN s AND e + 6
) SELECT alert_id, CASE WHEN alert_id IN (SELECT alert_id FROM x) THEN '{R.EXCLUDED}' WHEN cases = 0 THEN '{R.NO_CASE}' WHEN early THEN '{R.EARLY}' WHEN NOT early THEN '{R.LATE}' ELSE '{R.OTHER}' END AS reason FROM f""")
def d26_false_reasons(spark, sf):
    """Every negative document as an alert; some stand for all channels and have two significant ones."""
    docs = documents(spark, sf).where("sentiment = -1").withColumn("d", times.day_number(F.col("day"), END))
    both = F.col("k") % 8 == 0
    channels = F.when(both, F.array(F.lit("COUPANG"), F.lit("NAVER"))).otherwise(F.array().cast("array<string>"))
    alerts = docs.select(F.col("item_id").alias("alert_id"), "product", "aspect", "source", F.when(both, "ALL").otherwise(F.col("channel")).alias("channel"), channels.alias("channels"), F.col("d").alias("day"))
    span = lambda rows, n: rows.select("product", "aspect", "source", "channel", F.col("d").alias("start"), (F.col("d") + n).alias("end")).distinct()
    return R.false_reasons(alerts, span(docs.where("k = 21 AND product > 'P002'"), 2), span(docs.where("k = 23"), 1))


@query(f""", g AS (
  SELECT product || source AS case_id, source, product, channel, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN min(aspect) ELSE max(aspect) END AS main_aspect FROM voc GROUP BY source, product, channel
), g2 AS (
  SELECT *, CASE n % 3 WHEN 0 THEN '{C.BIASED}' WHEN 1 THEN '{C.GLOBAL}' ELSE '{C.NORMAL}' END AS verdict, CASE n % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS is_biased, CASE WHEN n % 5 < 3 THEN CASE WHEN n % 2 = 0 THEN '{C.HIGH}' ELSE '{C.MEDIUM}' END END AS confidence,
    n % 4 = 0 AS uncaused, n % 2 = 0 AS significant FROM g WHERE n % 7 <> 0
), p AS (
  SELECT source, product, arg_min(CASE nn % 3 WHEN 0 THEN '{C.BIASED}' ELSE '{C.GLOBAL}' END, channel) AS pv, arg_min(a, channel) AS pa, arg_min(CASE WHEN nn % 2 = 0 THEN '{C.HIGH}' ELSE '{C.MEDIUM}' END, channel) AS pc
  FROM (SELECT source, product, channel, count(*) AS nn, min(aspect) AS a FROM voc WHERE sentiment = -1 AND product < 'P010' GROUP BY source, product, channel) GROUP BY source, product
), t AS (
  SELECT product, aspect, channel, source, count(*) FILTER (sentiment = -1) * 4 > count(*) AS fired FROM voc GROUP BY ALL
), s AS (
  SELECT g1.*, coalesce(pv, '{C.NORMAL}') AS pv, pa, pc FROM (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY case_id, source ORDER BY channel) = 1) g1 LEFT JOIN p USING (product, source)
), c AS (
  SELECT count(*) AS channels, count(*) FILTER (significant = coalesce(fired, FALSE)) AS channels_right FROM g2 LEFT JOIN p USING (product, source) LEFT JOIN t ON t.product = g2.product AND t.aspect = pa AND t.channel = g2.channel AND t.source = g2.source WHERE verdict = '{C.BIASED}'
) SELECT count(*) FILTER (verdict <> '{C.NORMAL}' AND pv <> '{C.NORMAL}') AS found, count(*) FILTER (verdict <> '{C.NORMAL}' AND pv = '{C.NORMAL}') AS missed, count(*) FILTER (verdict = '{C.NORMAL}' AND pv <> '{C.NORMAL}') AS false, count(*) FILTER (verdict = '{C.NORMAL}' AND pv = '{C.NORMAL}') AS quiet,
  count(*) FILTER (verdict = pv) AS verdicts, count(*) FILTER (verdict <> '{C.NORMAL}' AND main_aspect IS NOT DISTINCT FROM pa) AS aspects, count(*) FILTER (is_biased IS NOT NULL) AS bias_claimed, count(*) FILTER (is_biased = (pv = '{C.BIASED}')) AS bias_right,
  count(*) FILTER (confidence IS NOT NULL) AS confidence_claimed, count(*) FILTER (confidence = pc) AS confidence_right, count(*) FILTER (verdict <> '{C.NORMAL}' AND uncaused AND main_aspect IN ('색상', '사이즈', '소재')) AS cause_skipped, any_value(channels) AS channels, any_value(channels_right) AS channels_right FROM s, c""")
def e08_cases_scored(spark, sf):
    """Cases of every product and source against predictions for most of them."""
    docs, n = documents(spark, sf), F.count("*")
    gold = docs.groupBy("source", "product", "channel").agg(n.alias("n"), F.when(n % 2 == 0, F.min("aspect")).otherwise(F.max("aspect")).alias("main_aspect"))
    n = F.col("n")
    gold = gold.withColumns({
        "case_id": F.concat("product", "source"), "verdict": F.when(n % 3 == 0, C.BIASED).when(n % 3 == 1, C.GLOBAL).otherwise(C.NORMAL), "is_biased": F.when(n % 3 < 2, n % 3 == 0),
        "confidence": F.when(n % 5 < 3, F.when(n % 2 == 0, C.HIGH).otherwise(C.MEDIUM)), "root_cause": F.when(n % 4 > 0, "cause"), "channel_significant": n % 2 == 0, "scoring_included": n % 7 != 0,
    })
    count = F.count("*")
    predicted = docs.where("sentiment = -1 AND product < 'P010'").groupBy("source", "product", "channel").agg(F.when(count % 3 == 0, C.BIASED).otherwise(C.GLOBAL).alias("verdict"), F.min("aspect").alias("main_aspect"), F.when(count % 2 == 0, C.HIGH).otherwise(C.MEDIUM).alias("confidence"))
    tests = docs.groupBy("product", "aspect", "channel", "source").agg((F.count_if(F.col("sentiment") == -1) * 4 > count).alias("fired"))
    return R.cases_scored(gold, predicted, tests)


@query("SELECT item_id, 'new' AS state FROM voc WHERE k % 2 = 0")
def k08_swapped(spark, sf):
    """Two versions of a table, one after the other; the pointer shows the second."""
    path, docs = shared_path(spark, "published"), documents(spark, sf)
    O.publish(docs.select("item_id", F.lit("old").alias("state")), path)
    O.publish(docs.where("k % 2 = 0").select("item_id", F.lit("new").alias("state")), path)
    return O.published(spark, path)


@query("SELECT item_id, CASE WHEN source = 'cs' THEN product || ', \"' || k || '\"' END AS product, CASE WHEN source = 'review' THEN channel END AS channel FROM voc")
def k09_united_headers(spark, sf):
    """Inquiries and reviews with unlike columns in one set of CSV files, and read back; some values hold commas and quotes."""
    path, docs = shared_path(spark, "csv"), documents(spark, sf)
    quoted = F.concat("product", F.lit(', "'), F.col("k").cast("string"), F.lit('"'))
    O.write_csv(O.united([docs.where("source = 'cs'").select("item_id", quoted.alias("product")), docs.where("source = 'review'").select("item_id", "channel")]), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.toDF(*(c.removeprefix("﻿") for c in rows.columns)).withColumn("item_id", F.col("item_id").cast("long"))
