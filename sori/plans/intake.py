"""Queries of samples, batches, checks of texts and answers, scalar functions, outputs and the replay."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import text as T
from sori.operators import outputs as O
from sori.operators import sampling as S
from sori.operators import validation as V
from sori.operators.replay import replay
from sori.plans.registry import query
from sori.sources.shared import shared_path
from sori.sources.voc import documents


@query("SELECT item_id, sentiment = -1 AS negative FROM voc QUALIFY row_number() OVER (PARTITION BY sentiment = -1 ORDER BY md5('7:' || item_id), item_id) <= CASE WHEN sentiment = -1 THEN 51 ELSE 50 END")
def w10_balanced_sample(spark, sf):
    rows = documents(spark, sf).select("item_id", (F.col("sentiment") == -1).alias("negative"))
    return S.balanced_sample(rows, "negative", "item_id", 101, 7)


@query("SELECT aspect, item_id FROM voc WHERE sentiment = -1 QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY md5('3:' || item_id), item_id) <= CASE WHEN aspect IN ('색상', '사이즈', '소재') THEN 30 ELSE 10 END")
def w11_quota_sample(spark, sf):
    quota = F.when(F.col("aspect").isin(*C.SCOPE), F.lit(30)).otherwise(F.lit(10))
    return S.quota_sample(documents(spark, sf).where("sentiment = -1").select("aspect", "item_id"), ["aspect"], "item_id", quota, 3)


@query("SELECT product, day, item_id, (row_number() OVER (PARTITION BY product, day ORDER BY item_id) - 1) // 20 AS batch FROM voc", dates=("day",))
def w12_batches(spark, sf):
    return S.batches(documents(spark, sf).select("product", "day", "item_id"), ["product", "day"], ["item_id"], 20)


@query(", g AS (SELECT product, count(*) AS n, min(item_id) AS f FROM voc GROUP BY product), c AS (SELECT product, sum(n) OVER (ORDER BY f) AS s, row_number() OVER (ORDER BY f) AS r, max(t) OVER () AS t FROM g CROSS JOIN (SELECT count(*) // 3 AS t FROM voc)) SELECT item_id, product FROM voc SEMI JOIN (SELECT product FROM c WHERE r = 1 OR s <= t) USING (product)")
def a37_whole_groups(spark, sf):
    docs = documents(spark, sf).select("item_id", "product")
    return S.whole_groups(docs, "product", "item_id", docs.count() // 3)


@query(", w AS (SELECT product, aspect, count(*) AS n FROM voc WHERE sentiment = -1 GROUP BY ALL), x AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY product) AS e FROM w), y AS (SELECT *, CAST(floor(e) AS BIGINT) AS low, round(e - floor(e), 9) AS rest FROM x), z AS (SELECT *, 100 - sum(low) OVER (PARTITION BY product) AS lft, row_number() OVER (PARTITION BY product ORDER BY rest DESC, aspect) AS place FROM y) SELECT product, aspect, low + CASE WHEN place <= lft THEN 1 ELSE 0 END AS part FROM z")
def a26_apportioned(spark, sf):
    weights = documents(spark, sf).where("sentiment = -1").groupBy("product", "aspect").agg(F.count("*").alias("n")).withColumn("total", F.lit(100))
    return S.apportioned(weights, ["product"], "aspect", "n", "total").select("product", "aspect", "part")


@query(", d AS (SELECT product, channel, day, count(*) AS n, count(*) FILTER (sentiment = -1) AS neg FROM voc GROUP BY ALL) SELECT product, channel, day, CAST(sum(n) OVER w AS BIGINT) AS n7, CAST(sum(neg) OVER w AS BIGINT) AS neg7 FROM d WINDOW w AS (PARTITION BY product, channel ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)", dates=("day",))
def a30_range_sums(spark, sf):
    daily = documents(spark, sf).groupBy("product", "channel", "day").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == -1).alias("neg"))
    week = Window.partitionBy("product", "channel").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return daily.select("product", "channel", "day", F.sum("n").over(week).alias("n7"), F.sum("neg").over(week).alias("neg7"))


@query("SELECT product, aspect, count(*) FILTER (sentiment = 1) AS pos, count(*) FILTER (sentiment = 0) AS neu, count(*) FILTER (sentiment = -1) AS neg FROM voc GROUP BY ALL")
def a15_sentiment_pivot(spark, sf):
    wide = documents(spark, sf).groupBy("product", "aspect").pivot("sentiment", [1, 0, -1]).count()
    return wide.select("product", "aspect", *(F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(n) for s, n in ((1, "pos"), (0, "neu"), (-1, "neg"))))


@query("SELECT product, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n FROM voc GROUP BY ALL", dates=("month",))
def a13_monthly_totals(spark, sf):
    return documents(spark, sf).groupBy("product", F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n"))


@query(", r AS (SELECT product, channel, avg(CASE WHEN sentiment = -1 THEN 1.0 ELSE 0.0 END) AS rate FROM voc WHERE NOT (product = 'P003' AND channel = 'NAVER') GROUP BY ALL) SELECT product, channel, round(rate, 9) AS rate FROM (SELECT DISTINCT product FROM voc) CROSS JOIN (VALUES ('COUPANG'), ('NAVER'), ('ZIGZAG')) c(channel) LEFT JOIN r USING (product, channel)")
def a23_channel_rates(spark, sf):
    rows = documents(spark, sf).withColumn("seen", ~((F.col("product") == "P003") & (F.col("channel") == "NAVER")))
    rate = lambda c: F.avg(F.when(F.col("seen") & (F.col("channel") == c), (F.col("sentiment") == -1).cast("double")))
    wide = rows.groupBy("product").agg(*(rate(c).alias(c) for c in C.CHANNELS))
    cells = F.array(*(F.struct(F.lit(c).alias("channel"), F.round(c, 9).alias("rate")) for c in C.CHANNELS))
    return wide.select("product", F.inline(cells))


@query("SELECT product, round(sum(least(k, 50) * n) / greatest(sum(n), 1) * 100, 6) AS share FROM (SELECT product, k, count(*) AS n FROM voc WHERE sentiment >= 0 GROUP BY ALL) GROUP BY product")
def a27_weighted_share(spark, sf):
    rows = documents(spark, sf).where("sentiment >= 0").groupBy("product", "k").agg(F.count("*").alias("n"))
    return rows.groupBy("product").agg(F.round(F.sum(F.least("k", F.lit(50)) * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)) * 100, 6).alias("share"))


@query("SELECT min(n) AS low, max(n) AS high, count(*) AS families FROM (SELECT product, count(DISTINCT channel || source) * 6 AS n FROM voc GROUP BY product)")
def a24_family_sizes(spark, sf):
    sizes = documents(spark, sf).groupBy("product").agg((F.countDistinct("channel", "source") * 6).alias("n"))
    return sizes.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("families"))


@query("SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)\\s*(%p|%|건|)')) AS BIGINT) AS found FROM conversations")
def x07_number_count(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit(V.NUMBER), 0)).cast("long").alias("found"))


@query("SELECT item_id, CASE WHEN k % 4 <> 0 AND abs(k / 2 - 20.0) > 0.5 THEN 1 ELSE 0 END AS ungrounded FROM voc")
def x08_grounding(spark, sf):
    k = F.col("k")
    text = F.when(k % 4 == 0, F.concat(F.lit("모두 "), k.cast("string"))).otherwise(F.concat(F.lit("비율 "), F.format_string("%.1f", k / 2), F.lit("%")))
    allowed = F.array(F.struct(F.lit(20.0).alias("value"), F.lit("%").alias("unit")))
    return documents(spark, sf).select("item_id", F.size(V.ungrounded_numbers(text, allowed)).alias("ungrounded"))


@query("SELECT doc_id, contains(lower(text), 'fdr') OR contains(lower(text), 'p-value') OR contains(lower(text), 'p값') OR contains(lower(text), 'p 값') OR contains(text, '유의확률') OR regexp_matches(lower(text), 'p\\s*[=<>≤≥]\\s*0?\\.\\d+') AS hit FROM documents")
def x09_forbidden(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", (F.size(T.forbidden(F.col("text"))) > 0).alias("hit"))


@query("SELECT p_partkey, len(list_filter(string_split(replace(p_type, ' ', '_'), '_'), lambda s: contains(lower(p_name || p_type), lower(s)))) * 2 >= len(string_split(replace(p_type, ' ', '_'), '_')) AS found FROM part")
def x05_label_parts(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", T.label_parts_found(F.replace("p_type", F.lit(" "), F.lit("_")), F.concat("p_name", "p_type")).alias("found"))


@query("SELECT name, n, CASE lower(trim(name)) WHEN '1' THEN 1 WHEN 'positive' THEN 1 WHEN '-1' THEN -1 WHEN 'negative' THEN -1 WHEN '0' THEN 0 END AS sentiment FROM (SELECT CASE k % 6 WHEN 0 THEN ' Positive' WHEN 1 THEN 'NEGATIVE' WHEN 2 THEN '-1' WHEN 3 THEN '0' WHEN 4 THEN '1' ELSE 'angry' END AS name, count(*) AS n FROM voc GROUP BY ALL)")
def x18_sentiment_names(spark, sf):
    names = F.element_at(F.array(*map(F.lit, (" Positive", "NEGATIVE", "-1", "0", "1", "angry"))), F.col("k") % 6 + 1)
    return documents(spark, sf).groupBy(names.alias("name")).agg(F.count("*").alias("n")).withColumn("sentiment", V.sentiment_of(F.col("name")))


@query("SELECT item_id, concat_ws(';', CASE WHEN k % 5 = 0 THEN 'unknown ids' END, CASE WHEN k % 7 = 0 THEN 'missing ids' END, CASE WHEN k % 11 = 0 AND k % 7 <> 0 THEN 'repeated ids' END, CASE WHEN k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 THEN 'order' END) AS errors FROM voc")
def z06_answer_errors(spark, sf):
    k, one, two = F.col("k"), F.col("item_id"), F.col("item_id") + 1
    ids = F.concat(F.array(one), F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(two)), F.when((k % 11 == 0) & (k % 7 != 0), F.array(two)).otherwise(F.array().cast("array<bigint>")), F.when(k % 5 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")))
    text = F.to_json(F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit("색상").alias("aspect"), F.lit(-1).alias("sentiment"))))
    return documents(spark, sf).select("item_id", F.concat_ws(";", V.answer_errors(F.array(one, two), V.parsed_answer(text))).alias("errors"))


@query("SELECT item_id, CASE WHEN k % 8 = 0 THEN CASE WHEN source = 'cs' THEN '기타' ELSE '' END WHEN source = 'review' AND aspect NOT IN ('색상', '사이즈', '소재') THEN '' ELSE aspect END AS labels FROM voc")
def z03_labels(spark, sf):
    one = F.array(F.struct(F.col("item_id").alias("id"), "aspect", "sentiment"))
    labels = V.parsed_answer(F.to_json(F.when(F.col("k") % 8 == 0, F.slice(one, 1, 0)).otherwise(one)))
    kept = V.allowed_labels(V.labels_or_default(labels, F.col("source")), F.col("source"))
    return documents(spark, sf).select("item_id", F.concat_ws(",", F.transform(kept, lambda x: x["aspect"])).alias("labels"))


@query("SELECT item_id, concat_ws(';', CASE WHEN k % 3 = 0 THEN 'ids differ' END, CASE WHEN k % 4 = 0 THEN 'attributes missing' END, CASE WHEN k % 5 = 0 THEN 'attributes made up' END, CASE WHEN k % 6 = 0 THEN 'numbers not grounded' END, CASE WHEN k % 7 = 0 THEN 'forbidden expressions' END) AS errors FROM voc")
def x11_report_errors(spark, sf):
    k = F.col("k")
    covered = F.concat(F.when(k % 4 == 0, F.array(F.lit("색상"))).otherwise(F.array(F.lit("색상"), F.lit("소재"))), F.when(k % 5 == 0, F.array(F.lit("기타"))).otherwise(F.array().cast("array<string>")))
    text = F.concat(F.lit("부정 13.0%"), F.when(k % 6 == 0, " 또는 44.0%").otherwise(""), F.when(k % 7 == 0, " (P = 0.03)").otherwise(""))
    allowed = F.concat(V.allowed_percents([F.lit(0.13)]), F.array(F.struct(F.lit(0.03).alias("value"), F.lit("").alias("unit"))))
    return documents(spark, sf).select("item_id", F.concat_ws(";", V.report_errors(k % 3 != 0, F.array(F.lit("색상"), F.lit("소재")), covered, text, allowed)).alias("errors"))


@query(f"SELECT item_id, CASE WHEN k % 10 = 0 THEN '{C.LOW}' WHEN k % 2 = 0 OR k % 5 = 3 THEN '{C.LOW}' WHEN k % 7 = 0 OR k % 5 = 1 THEN '{C.MEDIUM}' WHEN k % 3 = 0 THEN '{C.HIGH}' ELSE '{C.MEDIUM}' END AS confidence FROM voc")
def d20_proposal_confidence(spark, sf):
    k = F.col("k")
    label = F.when(k % 10 == 0, C.UNSOLVABLE[0]).when(k % 7 == 0, "기타").otherwise("사진_부족")
    detection = F.when(k % 5 == 1, C.MEDIUM).when(k % 5 == 3, C.NOT_APPLICABLE).otherwise(C.HIGH)
    return documents(spark, sf).select("item_id", V.proposal_confidence(label, k % 2 != 0, k % 3 == 0, F.lit(False), detection).alias("confidence"))


@query("SELECT item_id, CASE WHEN k % 20 <> 0 THEN concat_ws('/', 'reports', source, product, strftime(day, '%Y'), strftime(day, '%m'), item_id || '.pdf') END AS path FROM voc")
def k12_storage_paths(spark, sf):
    period = F.when(F.col("k") % 20 == 0, "2024-13").otherwise(F.date_format("day", "yyyy-MM"))
    return documents(spark, sf).select("item_id", O.storage_path(F.col("source"), F.col("product"), period, F.concat(F.col("item_id").cast("string"), F.lit(".pdf"))).alias("path"))


@query("SELECT item_id, '{\"event_type\":\"anomaly\",\"occurred_at\":\"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\",\"data\":{\"product\":\"' || product || '\",\"aspect\":\"' || aspect || '\"}}' AS payload FROM voc")
def k11_payloads(spark, sf):
    return documents(spark, sf).select("item_id", O.payload("anomaly", F.col("occurred_at"), "product", "aspect").alias("payload"))


@query("SELECT item_id, day, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM voc WHERE day >= DATE '2024-01-10'", dates=("day",))
def k07_retained(spark, sf):
    docs = documents(spark, sf)
    new = docs.where("k % 2 = 0").select("item_id", "day", F.lit("new").alias("state"))
    return O.retained(docs.select("item_id", "day", F.lit("old").alias("state")), new, "item_id", "day", "2024-01-10")


@query()
def r09_replay(spark, sf):
    return replay(documents(spark, sf), "2024-01-24", "2024-01-30", shared_path(spark, "replay"))
