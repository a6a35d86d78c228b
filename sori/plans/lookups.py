"""Queries of joins, counts and sets over documents, labels, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.operators import cases as K
from sori.operators import detection as D
from sori.operators import snapshots as S
from sori.plans.audits import AUDIT, alerts
from sori.plans.queries import CANDIDATES, grid_of
from sori.plans.registry import END, query
from sori.sources.voc import documents


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def count_if(sql: str) -> F.Column:
    return F.count_if(F.expr(sql))


def rows_n() -> F.Column:
    return F.count("*").alias("n")


@query("SELECT product, count(*) AS items, count(*) FILTER (sentiment = 0) AS without, count(*) FILTER (sentiment <> 0) AS labels FROM voc WHERE k % 9 <> 0 GROUP BY product")
def j02_parent_child(spark, sf):
    docs = documents(spark, sf)
    parents = docs.where("k % 9 <> 0").select("item_id")
    labels = docs.where("sentiment <> 0").select("item_id", F.col("sentiment").alias("label"))
    rows = docs.select("item_id", "product").join(parents, "item_id").join(labels, "item_id", "left")
    return rows.groupBy("product").agg(F.count("*").alias("items"), count_if("label IS NULL").alias("without"), F.count("label").alias("labels"))


@query("SELECT l_orderkey AS item_id, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-07-01') GROUP BY l_orderkey")
def j03_nested_items(spark, sf):
    """Lines of one order are few, so that a list of them is bounded."""
    wanted = table(spark, sf, "orders").where("o_orderdate >= '1996-01-01' AND o_orderdate < '1996-07-01'").select(F.col("o_orderkey").alias("item_id"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("line"))
    nested = rows.join(wanted, "item_id", "left_semi").groupBy("item_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return nested.select("item_id", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("SELECT product, aspect, CAST(date_trunc('month', day) AS DATE) AS month, count(*) AS n FROM voc WHERE sentiment = -1 AND k % 9 <> 0 GROUP BY ALL", dates=("month",))
def j04_monthly_numerators(spark, sf):
    docs = documents(spark, sf)
    labels = docs.where("sentiment = -1 AND k % 9 <> 0").select("item_id", "aspect")
    return docs.drop("aspect").join(labels, "item_id").groupBy("product", "aspect", F.trunc("day", "month").alias("month")).agg(rows_n())


@query("SELECT p_brand AS grp, count(*) AS n, count(DISTINCT l_partkey) AS variants FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def j05_mapped_variants(spark, sf):
    mapping = table(spark, sf, "part").select(F.col("p_partkey").alias("variant"), F.col("p_brand").alias("grp"))
    sold = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("variant")).agg(rows_n())  # counted by variant before the join
    return sold.join(mapping, "variant").groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("variants"))


@query("SELECT item_id, k % 5 AS attempts FROM voc WHERE k % 7 = 0 AND k % 5 < 3")
def j09_retryable(spark, sf):
    docs = documents(spark, sf)
    failures = docs.where("k % 7 = 0").select("item_id", (F.col("k") % 5).alias("attempts"))
    return failures.where("attempts < 3").join(docs.select("item_id"), "item_id")


@query("SELECT product, source, count(*) AS n FROM voc WHERE k % 9 <> 0 AND k % 4 <> 2 GROUP BY ALL")
def j10_stale(spark, sf):
    docs = documents(spark, sf)
    done = docs.where("k % 9 <> 0").select("item_id", F.when(F.col("k") % 4 == 2, "v2").when(F.col("k") % 4 == 1, "v1").alias("version"))
    return docs.join(done.where(~F.col("version").eqNullSafe("v2")), "item_id").groupBy("product", "source").agg(rows_n())


@query(CANDIDATES + "SELECT product, channel, c.verdict AS cs_verdict, r.verdict AS review_verdict, CASE WHEN c.verdict IS NOT NULL THEN 'cs' ELSE 'review' END AS primary_source FROM (SELECT * FROM cands WHERE source = 'cs') c FULL JOIN (SELECT * FROM cands WHERE source = 'review') r USING (product, channel)")
def j13_candidate_sources(spark, sf):
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    rows = D.candidates(D.verdicts(grid, tests), tests)
    side = lambda s: rows.where(F.col("source") == s).select("product", "channel", F.col("verdict").alias(f"{s}_verdict"))
    both = side("cs").join(side("review"), ["product", "channel"], "full_outer")
    return both.withColumn("primary_source", F.when(F.col("cs_verdict").isNotNull(), "cs").otherwise("review"))


@query(""", l AS (SELECT product, aspect, channel, max(day) AS last_day FROM voc WHERE sentiment = -1 AND k % 5 <> 0 AND day < DATE '2024-01-30' GROUP BY ALL)
SELECT n.product, n.aspect, n.channel, l.last_day FROM (SELECT DISTINCT product, aspect, channel FROM voc WHERE day = DATE '2024-01-30') n LEFT JOIN l USING (product, aspect, channel)""", dates=("last_day",))
def j14_latest_prior(spark, sf):
    docs, key = documents(spark, sf), ["product", "aspect", "channel"]
    prior = docs.where((F.col("sentiment") == -1) & (F.col("k") % 5 != 0) & (F.col("day") < END)).groupBy(*key).agg(F.max("day").alias("last_day"))
    return docs.where(F.col("day") == END).select(*key).distinct().join(prior, key, "left")


@query(AUDIT + ", x AS (SELECT DISTINCT product, aspect, day FROM al) SELECT v.product, v.aspect, count(*) AS n FROM voc v ANTI JOIN x ON v.product = x.product AND v.aspect = x.aspect AND v.day = x.day GROUP BY ALL")
def j15_outside_alert_days(spark, sf):
    key = ["product", "aspect", "day"]
    daily = documents(spark, sf).groupBy(*key).agg(rows_n())
    return daily.join(alerts(spark, sf).select(*key).distinct(), key, "left_anti").groupBy("product", "aspect").agg(F.sum("n").alias("n"))


@query(", c AS (SELECT DISTINCT product, aspect FROM voc WHERE k = 50) SELECT v.product, v.aspect, count(*) AS n, bool_or(c.product IS NOT NULL) AS changed FROM voc v LEFT JOIN c ON v.product = c.product AND v.aspect = c.aspect GROUP BY ALL")
def j16_change_logged(spark, sf):
    docs, key = documents(spark, sf), ["product", "aspect"]
    log = docs.where("k = 50").select(*key).distinct().withColumn("changed", F.lit(True))
    return docs.groupBy(*key).agg(rows_n()).join(log, key, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@query("SELECT product, count(*) AS gold, count(*) FILTER (k % 13 <> 6) AS scored, count(*) FILTER (k % 13 = 6) AS unanswered, count(*) FILTER (k % 13 <> 6 AND k % 9 <> 4) AS correct FROM voc GROUP BY product")
def j17_scored(spark, sf):
    docs = documents(spark, sf)
    answers = docs.where("k % 13 <> 6").select("item_id", F.when(F.col("k") % 9 == 4, "-").otherwise(F.col("aspect")).alias("answer"))
    rows = docs.join(answers, "item_id", "left")
    return rows.groupBy("product").agg(F.count("*").alias("gold"), F.count("answer").alias("scored"), count_if("answer IS NULL").alias("unanswered"), count_if("answer = aspect").alias("correct"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS unlabelled, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def j18_label_lookup(spark, sf):
    labels = table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return rows.groupBy("lang").agg(rows_n(), count_if("labelled IS NULL").alias("unlabelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


@query("SELECT 'part' AS side, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3) UNION ALL SELECT 'lineitem', l_partkey FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity < 3) x WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def j24_completeness(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    sold = table(spark, sf, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("id")).distinct()
    one = part.join(sold, "id", "left_anti").select(F.lit("part").alias("side"), "id")
    return one.unionByName(sold.join(part, "id", "left_anti").select(F.lit("lineitem").alias("side"), "id"))


@query(""", c AS (SELECT product, channel, source, aspect, count(*) FILTER (sentiment = -1) AS neg, 100 + count(*) AS total FROM voc WHERE k % 4 = 0 AND channel <> 'ZIGZAG' AND aspect <> '기타' GROUP BY ALL),
s AS (SELECT product, channel, source, max(total) AS st FROM c GROUP BY ALL)
SELECT product, channel, source, aspect, coalesce(neg, 0) AS neg, coalesce(total, st, 42) AS total FROM (SELECT product, channel, source, unnest(['색상', '사이즈', '소재', '파손', '오배송', '기타']) AS aspect FROM (SELECT product, channel, unnest(['cs', 'review']) AS source FROM (SELECT DISTINCT product, unnest(['COUPANG', 'NAVER', 'ZIGZAG']) AS channel FROM voc))) x
LEFT JOIN c USING (product, channel, source, aspect) LEFT JOIN s USING (product, channel, source)""")
def j26_grid(spark, sf):
    docs = documents(spark, sf)
    config = docs.where("k % 4 = 0 AND channel <> 'ZIGZAG' AND aspect <> '기타'").groupBy("product", "channel", "source", "aspect").agg(count_if("sentiment = -1").alias("neg"), (F.count("*") + 100).alias("total"))
    return K.grid(docs, tuple(C.ASPECTS), config, 42)


@query(""", n AS (SELECT product, aspect, count(*) FILTER (channel = 'COUPANG') AS c, count(*) FILTER (channel = 'NAVER') AS v, count(*) FILTER (channel = 'ZIGZAG') AS z FROM voc GROUP BY ALL)
SELECT product, aspect, 'COUPANG' AS a, 'NAVER' AS b, c AS n_a, v AS n_b FROM n UNION ALL SELECT product, aspect, 'COUPANG', 'ZIGZAG', c, z FROM n UNION ALL SELECT product, aspect, 'NAVER', 'ZIGZAG', v, z FROM n""")
def j28_channel_pairs(spark, sf):
    return K.channel_pairs(documents(spark, sf), ["product", "aspect"])


@query("SELECT product, channel, source, count(*) AS total, count(*) FILTER (sentiment = -1) AS neg FROM voc WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY ALL")
def a01_window_counts(spark, sf):
    rows = documents(spark, sf).where(F.col("day").between("2024-01-10", "2024-01-16"))
    return rows.groupBy("product", "channel", "source").agg(F.count("*").alias("total"), count_if("sentiment = -1").alias("neg"))


@query("SELECT DISTINCT product, channel, source FROM voc WHERE k % 9 = 0 AND day >= DATE '2024-01-24'")
def a07_unreliable_slots(spark, sf):
    return documents(spark, sf).where((F.col("k") % 9 == 0) & (F.col("day") >= "2024-01-24")).select("product", "channel", "source").distinct()


@query("SELECT count(*) AS items, count(*) FILTER (k % 4 <> 2) AS stale, count(*) FILTER (k % 4 <> 2) = 0 AS ready FROM voc WHERE k % 9 <> 0")
def a08_version_cutover(spark, sf):
    rows = documents(spark, sf).where("k % 9 <> 0")
    return rows.agg(F.count("*").alias("items"), count_if("k % 4 <> 2").alias("stale")).withColumn("ready", F.col("stale") == 0)


@query("SELECT source, count(*) AS total, count(*) FILTER (k % 9 = 0) AS pending, count(*) FILTER (k % 9 = 0 AND k % 5 >= 3) AS exhausted FROM voc GROUP BY source")
def a10_coverage_log(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count("*").alias("total"), count_if("k % 9 = 0").alias("pending"), count_if("k % 9 = 0 AND k % 5 >= 3").alias("exhausted"))


@query("SELECT count(*) FILTER (toxic IS NOT NULL AND d.doc_id IS NOT NULL AND d.lang <> 'en') AS stale, count(*) FILTER (d.doc_id IS NULL) AS orphans FROM labels l LEFT JOIN documents d USING (doc_id)")
def a11_stale_and_orphans(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.lit(True).alias("seen"))
    rows = table(spark, sf, "labels").join(docs, "doc_id", "left")
    return rows.agg(count_if("toxic IS NOT NULL AND seen AND lang <> 'en'").alias("stale"), count_if("seen IS NULL").alias("orphans"))


@query("SELECT product, count(*) AS n FROM voc GROUP BY product ORDER BY product")
def a14_products(spark, sf):
    return documents(spark, sf).groupBy("product").agg(rows_n()).orderBy("product")


@query(", c AS (SELECT *, CASE WHEN k % 10 = 0 THEN lower(channel) WHEN k = 99 THEN 'OTHER' ELSE channel END AS raw FROM voc) SELECT coalesce(CASE WHEN upper(raw) IN ('COUPANG', 'NAVER', 'ZIGZAG') THEN upper(raw) END, 'unknown') AS channel, aspect, count(*) AS n FROM c WHERE sentiment = -1 GROUP BY ALL")
def a16_negatives_by_channel(spark, sf):
    raw = F.when(F.col("k") % 10 == 0, F.lower("channel")).when(F.col("k") == 99, "OTHER").otherwise(F.col("channel"))
    rows = documents(spark, sf).where("sentiment = -1").withColumn("channel", F.upper(raw))
    known = F.when(F.col("channel").isin(*C.CHANNELS), F.col("channel")).otherwise("unknown")
    return rows.groupBy(known.alias("channel"), "aspect").agg(rows_n())


@query(", r AS (SELECT unnest(list_filter([CASE WHEN k % 3 = 0 THEN 'no quote' END, CASE WHEN k % 5 = 0 THEN 'wrong label' END], lambda x: x IS NOT NULL)) AS reason, source FROM voc) SELECT source, reason, count(*) AS n FROM r GROUP BY ALL")
def a22_reject_reasons(spark, sf):
    reasons = F.array_compact(F.array(F.when(F.col("k") % 3 == 0, "no quote"), F.when(F.col("k") % 5 == 0, "wrong label")))
    return documents(spark, sf).select("source", F.explode(reasons).alias("reason")).groupBy("source", "reason").agg(rows_n())


@query("SELECT count(*) AS documents, count(DISTINCT product) AS products, count(*) FILTER (k % 9 = 0) AS failed, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM voc")
def a28_batch_summary(spark, sf):
    day = lambda f, name: f("day").cast("string").alias(name)
    return documents(spark, sf).agg(F.count("*").alias("documents"), F.countDistinct("product").alias("products"), count_if("k % 9 = 0").alias("failed"), day(F.min, "first_day"), day(F.max, "last_day"))


@query("SELECT product, channel, source, day, aspect, count(*) AS n FROM voc WHERE sentiment = -1 AND (source = 'cs' OR aspect IN ('색상', '사이즈', '소재')) GROUP BY ALL", dates=("day",))
def a29_daily_negatives(spark, sf):
    allowed = (F.col("source") == "cs") | F.col("aspect").isin(*C.REVIEW_ASPECTS)
    return documents(spark, sf).where((F.col("sentiment") == -1) & allowed).groupBy("product", "channel", "source", "day", "aspect").agg(rows_n())


@query("SELECT product, round(avg(CASE WHEN sentiment = -1 THEN 1.0 ELSE 0.0 END), 9) AS rate, round(avg(CASE WHEN sentiment = -1 AND aspect = '색상' THEN 1.0 ELSE 0.0 END) FILTER (channel = 'NAVER' AND day < DATE '2024-01-24'), 9) AS color_rate FROM voc GROUP BY product")
def a32_conditional_rates(spark, sf):
    hit = F.col("sentiment") == -1
    some = (F.col("channel") == "NAVER") & (F.col("day") < "2024-01-24")
    color = F.when(some, (hit & (F.col("aspect") == "색상")).cast("double"))
    return documents(spark, sf).groupBy("product").agg(F.round(F.avg(hit.cast("double")), 9).alias("rate"), F.round(F.avg(color), 9).alias("color_rate"))


@query(", c AS (SELECT product, count(*) AS n, 400 AS expected FROM voc WHERE sentiment = -1 GROUP BY product) SELECT product, n, abs(n - expected) <= 0.1 * expected AS pass FROM c")
def a33_count_check(spark, sf):
    rows = documents(spark, sf).where("sentiment = -1").groupBy("product").agg(rows_n())
    return rows.withColumn("pass", F.abs(F.col("n") - 400) <= 0.1 * 400)


@query("SELECT product, count(DISTINCT channel) AS channels, count(DISTINCT channel) = 3 AS complete, round(count(*) / (SELECT count(*) FROM voc), 9) AS share FROM voc GROUP BY product")
def a34_distribution(spark, sf):
    rows = documents(spark, sf).groupBy("product", "channel").agg(rows_n())
    out = rows.groupBy("product").agg(F.count("*").alias("channels"), F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row for each product
    return out.select("product", "channels", (F.col("channels") == len(C.CHANNELS)).alias("complete"), F.round(share, 9).alias("share"))


@query("SELECT product, aspect, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, aspect) AS rank FROM (SELECT product, aspect, count(*) AS n FROM voc GROUP BY ALL)) WHERE rank <= 3")
def w07_most_common(spark, sf):
    return K.most_common(documents(spark, sf), ["product"], "aspect", 3)


@query("SELECT product, channel, source, item_id FROM voc WHERE sentiment = -1 QUALIFY row_number() OVER (PARTITION BY product, channel, source ORDER BY occurred_at, item_id) <= 5")
def w06_first_quotes(spark, sf):
    """The first five of each slot; every partition keeps its own first five before rows are exchanged."""
    first = F.row_number().over(Window.partitionBy("product", "channel", "source").orderBy("occurred_at", "item_id"))
    rows = documents(spark, sf).where("sentiment = -1").withColumn("rank", first).where("rank <= 5")
    return rows.select("product", "channel", "source", "item_id")


@query("SELECT product, max_by(day, (day, item_id)) AS day, max_by(item_id, (day, item_id)) AS item_id FROM voc GROUP BY product", dates=("day",))
def w02_latest(spark, sf):
    return documents(spark, sf).groupBy("product").agg(F.max(F.struct("day", "item_id")).alias("last")).select("product", "last.day", "last.item_id")


@query("SELECT product, aspect, channel, n FROM (SELECT product, aspect, channel, count(*) AS n FROM voc WHERE sentiment = -1 GROUP BY ALL) ORDER BY n DESC, product, aspect, channel LIMIT 20")
def w08_alert_budget(spark, sf):
    """A top-k report: alerts of a run up to its budget."""
    rows = documents(spark, sf).where("sentiment = -1").groupBy("product", "aspect", "channel").agg(rows_n())
    return rows.orderBy(F.desc("n"), "product", "aspect", "channel").limit(20)


@query(", s AS (SELECT product, aspect, list_sort(list(DISTINCT channel) FILTER (source = 'cs')) AS a, list_sort(list(DISTINCT channel) FILTER (source = 'review')) AS b FROM voc WHERE sentiment = -1 GROUP BY ALL) SELECT product, aspect, array_to_string(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x)), ',') AS shared FROM s")
def u04_shared_channels(spark, sf):
    sides = [F.collect_set(F.when(F.col("source") == s, F.col("channel"))) for s in ("cs", "review")]
    rows = documents(spark, sf).where("sentiment = -1").groupBy("product", "aspect").agg(sides[0].alias("a"), sides[1].alias("b"))
    return rows.select("product", "aspect", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"))


@query(", a AS (SELECT DISTINCT product, channel, aspect FROM voc WHERE k = 1), b AS (SELECT DISTINCT product, channel, aspect FROM voc WHERE k = 2) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def u05_symmetric_difference(spark, sf):
    key = ["product", "channel", "aspect"]
    rows = documents(spark, sf).where("k IN (1, 2)").groupBy(*key).agg(F.countDistinct("k").alias("sides"))
    return rows.where("sides = 1").select(*key)


@query(", l AS (SELECT item_id, unnest([k % 3, k % 5, k % 3, k % 2, k % 5]) AS x, unnest([0, 1, 2, 3, 4]) AS i FROM voc), f AS (SELECT item_id, x, min(i) AS i FROM l GROUP BY ALL) SELECT item_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS xs FROM f GROUP BY item_id")
def u06_ordered_distinct(spark, sf):
    k = F.col("k")
    return documents(spark, sf).select("item_id", F.array_join(F.array_distinct(F.array(*((k % n).cast("string") for n in (3, 5, 3, 2, 5)))), ",").alias("xs"))


@query("SELECT item_id, aspect, CAST(sentiment AS INTEGER) AS sentiment, 0 AS pos FROM voc WHERE k % 10 <> 3 UNION ALL SELECT item_id, '기타', 1, 1 FROM voc WHERE k % 10 = 3 AND k % 20 <> 3")
def k02_replaced_labels(spark, sf):
    docs = documents(spark, sf)
    old = docs.select("item_id", "aspect", "sentiment", F.lit(0).alias("pos"))
    answered = docs.where("k % 10 = 3")
    label = lambda s, pos: F.struct(F.lit("기타").alias("aspect"), F.lit(s).alias("sentiment"), F.lit(pos).alias("pos"))
    new = answered.where("k % 20 <> 3").select("item_id", F.inline(F.array(label(0, 2), label(1, 1))))
    return K.replaced_children(old, new, answered)


@query("SELECT item_id FROM voc WHERE k % 7 = 0 AND k % 2 = 1")
def k04_cleared_failures(spark, sf):
    docs = documents(spark, sf)
    return docs.where("k % 7 = 0").select("item_id").join(docs.where("k % 2 = 0").select("item_id"), "item_id", "left_anti")


@query(", x AS (SELECT 1) SELECT CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'handled' ELSE 'dead letter' END AS route, event_type, count(*) AS n FROM events GROUP BY ALL")
def r11_unknown_events(spark, sf):
    kept, dead = S.quarantine(table(spark, sf, "events"), {"dead letter": ~F.col("event_type").isin("click", "view", "purchase")})
    return kept.withColumn("reason", F.lit("handled")).unionByName(dead).groupBy(F.col("reason").alias("route"), "event_type").agg(rows_n())
