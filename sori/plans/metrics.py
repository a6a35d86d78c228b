"""Queries of measures of predictions against gold labels, over the documents with predictions derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sori.constants import ASPECTS
from sori.operators import evaluation as E
from sori.plans.registry import query
from sori.sources.voc import documents

#: Predictions: another attribute where k % 9 = 4, another sentiment where k % 11 = 5, none where k % 13 = 6, one more attribute where k % 17 = 3.
PRED = """, pr AS (
  SELECT *, CASE WHEN k % 9 = 4 THEN '기타' ELSE aspect END AS pred_aspect, CASE WHEN k % 11 = 5 THEN CASE WHEN sentiment = -1 THEN 0 ELSE -1 END ELSE sentiment END AS pred_sentiment, product || ' ' || k AS content FROM voc
), pl AS (
  SELECT item_id, product, pred_aspect AS aspect, pred_sentiment AS sentiment FROM pr WHERE k % 13 <> 6 UNION ALL SELECT item_id, product, '배송', 0 FROM pr WHERE k % 13 <> 6 AND k % 17 = 3
), sides AS (
  SELECT coalesce(g.item_id, p.item_id) AS item_id, coalesce(g.product, p.product) AS product, coalesce(g.aspect, p.aspect) AS aspect, g.sentiment AS gold, p.sentiment AS pred
  FROM (SELECT item_id, product, aspect, sentiment FROM voc WHERE k % 13 <> 6) g FULL JOIN pl p ON g.item_id = p.item_id AND g.aspect = p.aspect
)
"""


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return documents(spark, sf).withColumns({
        "pred_aspect": F.when(k % 9 == 4, "기타").otherwise(F.col("aspect")),
        "pred_sentiment": F.when(k % 11 == 5, F.when(F.col("sentiment") == -1, 0).otherwise(-1)).otherwise(F.col("sentiment")),
        "content": F.concat_ws(" ", "product", k.cast("string")),
    })


def sides(spark: SparkSession, sf: str) -> DataFrame:
    rows = predicted(spark, sf)
    first = F.struct(F.col("pred_aspect").alias("aspect"), F.col("pred_sentiment").alias("sentiment"))
    more = F.struct(F.lit("배송").alias("aspect"), F.lit(0).alias("sentiment"))
    answers = F.when(F.col("k") % 17 == 3, F.array(first, more)).otherwise(F.array(first))
    labels = rows.where("k % 13 <> 6").select("item_id", "product", F.inline(answers))
    return E.matches(rows.select("item_id", "product", "aspect", "sentiment"), labels, ["item_id", "product"])


SCORES = "count(*) FILTER (gold IS NOT NULL AND pred IS NOT NULL) AS tp, count(*) FILTER (gold IS NULL) AS fp, count(*) FILTER (pred IS NULL) AS fn, count(*) FILTER (gold = pred) AS ok"
RATIOS = "tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(ok / nullif(tp, 0), 0), 9) AS sentiment_accuracy"


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 9) for n in names})


@query(PRED + f"SELECT aspect, {RATIOS} FROM (SELECT aspect, {SCORES} FROM sides GROUP BY aspect)")
def e05_attribute_scores(spark, sf):
    return _rounded(E.attribute_scores(sides(spark, sf), ["aspect"]), "precision", "recall", "f1", "sentiment_accuracy")


@query(PRED + f"SELECT {RATIOS} FROM (SELECT {SCORES} FROM sides)")
def e01_overall_scores(spark, sf):
    return _rounded(E.attribute_scores(sides(spark, sf), []), "precision", "recall", "f1", "sentiment_accuracy")


@query(PRED + ", i AS (SELECT product, item_id, bool_and(coalesce(gold = pred, FALSE)) AS exact FROM sides GROUP BY ALL) SELECT product, count(*) AS items, count(*) FILTER (exact) AS exact, round(count(*) FILTER (exact) / count(*), 9) AS exact_share FROM i GROUP BY product")
def e01_exact_share(spark, sf):
    return _rounded(E.exact_share(sides(spark, sf), ["item_id"], ["product"]), "exact_share")


@query(PRED + """, t AS (SELECT product, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn FROM (SELECT product, sentiment = -1 AS g, pred_sentiment = -1 AND NOT (k % 11 = 5 AND product = 'P003') AS p FROM pr) GROUP BY product),
r AS (SELECT *, tp / nullif(tp + fn, 0) AS rc, fp / nullif(fp + tn, 0) AS fr FROM t)
SELECT product, tp, fp, fn, tn, CASE WHEN fp + tn > 0 THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 9) END AS precision, round(rc, 9) AS recall, CASE WHEN fp + tn > 0 AND tp + fn > 0 THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) END AS f1, round(fr, 9) AS fpr,
  round(CAST(0.074 AS DOUBLE) * rc / nullif(CAST(0.074 AS DOUBLE) * rc + CAST(0.926 AS DOUBLE) * fr, 0), 9) AS operational_precision, CASE WHEN fp = 0 AND tp > 0 THEN round(CAST(0.074 AS DOUBLE) * rc / (CAST(0.074 AS DOUBLE) * rc + CAST(0.926 AS DOUBLE) * 3 / (fp + tn)), 9) END AS operational_lower FROM r""")
def e02_negatives(spark, sf):
    unseen = (F.col("k") % 11 == 5) & (F.col("product") == "P003")
    rows = predicted(spark, sf).select("product", (F.col("sentiment") == -1).alias("gold_negative"), ((F.col("pred_sentiment") == -1) & ~unseen).alias("pred_negative"))
    return _rounded(E.negative_table(rows, ["product"], 0.074), "precision", "recall", "f1", "fpr", "operational_precision", "operational_lower")


@query(PRED + "SELECT source, round(avg(v), 9) AS mean, round(min(v), 9) AS low, round(max(v), 9) AS high, round((max(v) - min(v)) / 2, 9) AS half_range FROM (SELECT source, k % 3 AS run, avg(CASE WHEN aspect = pred_aspect THEN 1.0 ELSE 0.0 END) AS v FROM pr GROUP BY ALL) GROUP BY source")
def e06_run_summary(spark, sf):
    runs = predicted(spark, sf).groupBy("source", F.col("k") % 3).agg(F.avg((F.col("aspect") == F.col("pred_aspect")).cast("double")).alias("v"))
    return _rounded(E.run_summary(runs, ["source"], "v"), "mean", "low", "high", "half_range")


@query(PRED + "SELECT product, CASE WHEN a AND s THEN 'right' WHEN a THEN 'sentiment' WHEN s THEN 'aspect' ELSE 'both' END AS kind, count(*) AS n FROM (SELECT product, aspect = pred_aspect AS a, sentiment = pred_sentiment AS s FROM pr) GROUP BY ALL")
def e09_error_kinds(spark, sf):
    return E.error_kinds(predicted(spark, sf)).groupBy("product", "kind").agg(F.count("*").alias("n"))


@query(PRED + "SELECT product, aspect, count(*) FILTER (sentiment = -1) AS restored, count(*) FILTER (pred_sentiment = -1) AS predicted FROM (SELECT product, pred_aspect AS aspect, sentiment, pred_sentiment FROM pr) GROUP BY ALL")
def e10_sentiment_restored(spark, sf):
    one = F.array(F.struct(F.col("pred_aspect").alias("aspect"), F.col("pred_sentiment").alias("sentiment")))
    rows = predicted(spark, sf).select("product", "pred_sentiment", F.inline(E.with_gold_sentiment(one, F.col("sentiment"))))
    return rows.groupBy("product", "aspect").agg(F.count_if(F.col("sentiment") == -1).alias("restored"), F.count_if(F.col("pred_sentiment") == -1).alias("predicted"))


@query(PRED + "SELECT product, source, count(*) AS flips, count(DISTINCT content) AS texts FROM pr WHERE sentiment <> -1 AND pred_sentiment = -1 GROUP BY ALL")
def e11_reverse_flips(spark, sf):
    return E.reverse_flips(predicted(spark, sf), ["product", "source"])


@query(PRED + "SELECT product, channel, source, pred_aspect AS to_aspect, count(*) FILTER (sentiment <> -1) AS added, count(*) FILTER (sentiment = -1) AS replaced FROM pr WHERE pred_sentiment = -1 AND (sentiment <> -1 OR aspect <> pred_aspect) GROUP BY ALL")
def e12_bumps(spark, sf):
    return E.bumps(predicted(spark, sf), ["product", "channel", "source"])


@query("SELECT product, avg(CASE WHEN sentiment = -1 THEN 1.0 ELSE 0.0 END) AS rate FROM voc WHERE source = 'cs' GROUP BY product")
def e17_operational_rate(spark, sf):
    return documents(spark, sf).where("source = 'cs'").groupBy("product").agg(F.avg((F.col("sentiment") == -1).cast("double")).alias("rate"))


@query("SELECT product, day, " + ", ".join(f"count(*) FILTER (aspect = '{a}' AND sentiment = -1) AS a{i}" for i, a in enumerate(ASPECTS)) + " FROM voc GROUP BY ALL", dates=("day",))
def z07_count_vectors(spark, sf):
    rows = documents(spark, sf).withColumn("neg", F.when(F.col("sentiment") == -1, 1))
    wide = rows.groupBy("product", "day").pivot("aspect", list(ASPECTS)).agg(F.count("neg"))
    return wide.select("product", "day", *(F.coalesce(a, F.lit(0)).alias(f"a{i}") for i, a in enumerate(ASPECTS)))
