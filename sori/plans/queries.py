"""One query for each operator, over the driver's tables, with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import stats
from sori.operators import detection as D
from sori.operators import monthly as M
from sori.operators import snapshots as S
from sori.operators import trends
from sori.operators import validation as V
from sori.operators.nearest import index, nearest, nearest_indexed
from sori.plans.registry import END, SQL, query
from sori.sources.voc import documents

GRID = f""", w AS (
  SELECT *, date_diff('day', day, DATE '{END}') < 7 AS now FROM voc WHERE date_diff('day', day, DATE '{END}') BETWEEN 0 AND 34
), t AS (
  SELECT product, channel, source, count(*) FILTER (now) AS cur_total, count(*) FILTER (NOT now) AS past_total FROM w GROUP BY ALL
), a AS (
  SELECT i - 1 AS aspect_no, ['색상', '사이즈', '소재', '파손', '오배송', '기타'][i] AS aspect FROM range(1, 7) r(i)
), n AS (
  SELECT product, channel, source, aspect, count(*) FILTER (now) AS cur_neg, count(*) FILTER (NOT now) AS past_neg FROM w WHERE sentiment = -1 GROUP BY ALL
), grid AS (
  SELECT t.*, a.aspect, a.aspect_no, coalesce(n.cur_neg, 0) AS cur_neg, coalesce(n.past_neg, 0) AS past_neg
  FROM t CROSS JOIN a LEFT JOIN n USING (product, channel, source, aspect)
), holds AS (
  SELECT *, CASE WHEN min(cur_total) OVER (PARTITION BY product, channel) < 10 THEN 'small_sample' WHEN past_total = 0 THEN 'no_baseline' END AS hold FROM grid
)
"""
LF = "lgamma(CAST({} AS DOUBLE) + 1)"


def _choose(n: str, k: str) -> str:
    return f"({LF.format(n)} - {LF.format(k)} - {LF.format(f'({n}) - ({k})')})"


FISHER = f"""least(1.0, list_sum(list_transform(range(cur_neg, least(cur_total, cur_neg + past_neg) + 1),
  lambda x: exp({_choose('cur_neg + past_neg', 'x')} + {_choose('cur_total + past_total - cur_neg - past_neg', 'cur_total - x')} - {_choose('cur_total + past_total', 'cur_total')}))))"""
TESTS = GRID + f""", p AS (
  SELECT *, {FISHER} AS p_value, CAST(cur_neg AS DOUBLE) / cur_total - CAST(past_neg AS DOUBLE) / past_total AS delta FROM holds WHERE hold IS NULL
), r AS (
  SELECT *, count(*) OVER (PARTITION BY product ORDER BY p_value) AS r, count(*) OVER (PARTITION BY product) AS m FROM p
), b AS (
  SELECT *, coalesce(r <= max(CASE WHEN p_value <= CAST(r AS DOUBLE) / m * CAST(0.05 AS DOUBLE) THEN r END) OVER (PARTITION BY product), FALSE) AS bh_significant FROM r
), tests AS (
  SELECT *, bh_significant AND delta >= 0.03 AS fired FROM b
)
"""
VERDICTS = TESTS + f""", hc AS (
  SELECT product, source, list_sort(list_distinct(list(channel))) AS holding FROM holds WHERE hold IS NOT NULL GROUP BY ALL
), g AS (
  SELECT product, aspect, aspect_no, source, coalesce(list_sort(list(channel) FILTER (fired)), []) AS channels, list_sort(list(channel)) AS testable FROM tests GROUP BY ALL
), v AS (
  SELECT g.*, list_filter(coalesce(holding, []), lambda x: NOT list_contains(testable, x)) AS held FROM g LEFT JOIN hc USING (product, source)
), verdicts AS (
  SELECT *, CASE WHEN len(channels) = 0 THEN '{C.NORMAL}' WHEN len(testable) = 1 THEN '{C.INDETERMINATE}'
    WHEN len(channels) = len(testable) AND len(held) > 0 THEN '{C.TENTATIVE}' WHEN len(channels) = len(testable) THEN '{C.GLOBAL}' ELSE '{C.BIASED}' END AS verdict FROM v
)
"""


def grid_of(spark: SparkSession, sf: str) -> DataFrame:
    return D.held_slots(D.slots(documents(spark, sf), END))


def tests_of(spark: SparkSession, sf: str) -> DataFrame:
    return D.tested(grid_of(spark, sf))


@query("SELECT item_id, product, channel, source, day, aspect, CAST(sentiment AS INTEGER) AS sentiment FROM voc WHERE date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND 34", dates=("day",))
def s02_documents(spark, sf):
    age = F.datediff(F.lit(END).cast("date"), F.col("day"))
    return documents(spark, sf).where(age.between(0, 34)).select("item_id", "product", "channel", "source", "day", "aspect", "sentiment")


@query("SELECT d.item_id, d.product, coalesce(n.negatives, 0) AS negatives FROM voc d LEFT JOIN (SELECT item_id, count(*) AS negatives FROM voc WHERE sentiment = -1 GROUP BY item_id) n USING (item_id)")
def j01_documents_classified(spark, sf):
    docs = documents(spark, sf)
    neg = docs.where("sentiment = -1").groupBy("item_id").agg(F.count("*").alias("negatives"))
    return docs.join(neg, "item_id", "left").select("item_id", "product", F.coalesce("negatives", F.lit(0)).cast("long").alias("negatives"))


@query(GRID + "SELECT product, channel, source, aspect, cur_neg, cur_total, past_neg, past_total FROM grid")
def a04_slots(spark, sf):
    return D.slots(documents(spark, sf), END).select("product", "channel", "source", "aspect", "cur_neg", "cur_total", "past_neg", "past_total")


@query(GRID + """, x AS (SELECT DISTINCT product, channel, day FROM w WHERE NOT now AND k = 7), g AS (
  SELECT w.product, w.channel, w.source, a.aspect, count(*) AS g_total, count(*) FILTER (sentiment = -1 AND w.aspect = a.aspect) AS g_neg
  FROM w JOIN x USING (product, channel, day) CROSS JOIN a WHERE NOT now AND a.aspect_no = 0 GROUP BY ALL)
SELECT grid.product, grid.channel, grid.source, grid.aspect, past_neg - coalesce(g_neg, 0) AS past_neg, past_total - coalesce(g_total, 0) AS past_total, past_total AS unfiltered_total
FROM grid LEFT JOIN g USING (product, channel, source, aspect)""")
def a02_baseline_exclusions(spark, sf):
    docs = documents(spark, sf)
    age = F.datediff(F.lit(END).cast("date"), F.col("day"))
    gone = docs.where((F.col("k") == 7) & age.between(7, 34)).select("product", F.lit("색상").alias("aspect"), "channel", "day")
    return D.slots(docs, END, gone).select("product", "channel", "source", "aspect", "past_neg", "past_total", "unfiltered_total")


@query(TESTS + "SELECT product, channel, source, aspect, round(p_value, 7) AS p_value, round(delta, 9) AS delta, delta >= 0.03 AS meaningful FROM tests")
def t01_fisher(spark, sf):
    return tests_of(spark, sf).select("product", "channel", "source", "aspect", F.round("p_value", 7).alias("p_value"), F.round("delta", 9).alias("delta"), "meaningful")


@query(GRID + "SELECT DISTINCT product, channel, source, hold FROM holds WHERE hold IS NOT NULL")
def t04_held(spark, sf):
    return grid_of(spark, sf).where("hold IS NOT NULL").select("product", "channel", "source", "hold").distinct()


@query(TESTS + "SELECT product, channel, source, aspect, bh_significant, fired FROM tests")
def t05_fires(spark, sf):
    return tests_of(spark, sf).select("product", "channel", "source", "aspect", "bh_significant", "fired")


@query(TESTS + """, rr AS (SELECT *, count(*) OVER (PARTITION BY product, source ORDER BY p_value) AS r2, count(*) OVER (PARTITION BY product, source) AS m2 FROM p)
SELECT product, channel, source, aspect, coalesce(r2 <= max(CASE WHEN p_value <= CAST(r2 AS DOUBLE) / m2 * CAST(0.05 AS DOUBLE) THEN r2 END) OVER (PARTITION BY product, source), FALSE) AS bh_significant FROM rr""")
def t07_family_product_source(spark, sf):
    return D.tested(grid_of(spark, sf), ("product", "source")).select("product", "channel", "source", "aspect", "bh_significant")


@query(TESTS + "SELECT product, channel, source, aspect, round(least(1.0, min(p_value * m / r) OVER (PARTITION BY product ORDER BY p_value DESC)), 7) AS q_value FROM tests")
def t09_q_values(spark, sf):
    return stats.q_values(tests_of(spark, sf), ["product"]).select("product", "channel", "source", "aspect", F.round("q_value", 7).alias("q_value"))


@query(VERDICTS + "SELECT product, aspect, source, verdict, array_to_string(channels, ',') AS channels, array_to_string(held, ',') AS held FROM verdicts")
def d01_verdicts(spark, sf):
    grid = grid_of(spark, sf)
    return D.verdicts(grid, D.tested(grid)).select("product", "aspect", "source", "verdict", F.concat_ws(",", "channels").alias("channels"), F.concat_ws(",", "held").alias("held"))


CANDIDATES = VERDICTS + f""", f AS (
  SELECT product, aspect, aspect_no, source, verdict, unnest(channels) AS fc FROM verdicts WHERE verdict <> '{C.NORMAL}'
), ff AS (
  SELECT f.product, f.aspect, f.aspect_no, f.source, f.verdict, CASE WHEN f.verdict IN ('{C.GLOBAL}', '{C.TENTATIVE}') THEN 'ALL' ELSE f.fc END AS channel, max(t.delta) AS delta
  FROM f JOIN tests t ON t.product = f.product AND t.aspect = f.aspect AND t.source = f.source AND t.channel = f.fc GROUP BY ALL
), fr AS (
  SELECT *, row_number() OVER (PARTITION BY source, product, channel ORDER BY delta DESC, aspect_no) AS rn FROM ff
), cands AS (
  SELECT source, product, channel, max(aspect) FILTER (rn = 1) AS main_aspect, max(verdict) FILTER (rn = 1) AS verdict, max(delta) FILTER (rn = 1) AS delta,
    coalesce(string_agg(aspect, ',' ORDER BY rn) FILTER (rn > 1), '') AS sub_aspects FROM fr GROUP BY ALL
)
"""


@query(CANDIDATES + "SELECT source, product, channel, main_aspect, verdict, round(delta, 9) AS delta, sub_aspects FROM cands")
def d06_candidates(spark, sf):
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    return D.candidates(D.verdicts(grid, tests), tests).withColumn("delta", F.round("delta", 9))


@query(CANDIDATES + f"""SELECT concat_ws('-', 'ALT', '20240130', product, CASE main_aspect WHEN '색상' THEN 'COLOR' WHEN '사이즈' THEN 'SIZE' WHEN '소재' THEN 'MATERIAL' WHEN '파손' THEN 'DAMAGE' WHEN '오배송' THEN 'MISDELIVERY' ELSE 'ETC' END, channel) AS alert_id,
  product, channel, main_aspect, sub_aspects, verdict, round(delta, 9) AS delta, source AS primary_source,
  CASE WHEN verdict IN ('{C.GLOBAL}', '{C.TENTATIVE}') THEN '{C.NOT_APPLICABLE}' WHEN verdict = '{C.INDETERMINATE}' THEN '{C.MEDIUM}'
    WHEN source = 'cs' AND n = 2 AND verdict = '{C.BIASED}' THEN '{C.MEDIUM}' ELSE '{C.LOW}' END AS confidence,
  CASE WHEN verdict IN ('{C.GLOBAL}', '{C.TENTATIVE}') THEN '{C.ACTIONS['product']}' WHEN verdict = '{C.INDETERMINATE}' THEN '{C.ACTIONS['undetermined']}'
    WHEN main_aspect = '파손' THEN '{C.ACTIONS['파손']}' WHEN main_aspect = '오배송' THEN '{C.ACTIONS['오배송']}' WHEN main_aspect = '기타' THEN '{C.ACTIONS['기타']}' ELSE '{C.ACTIONS['channel']}' END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY product, channel ORDER BY source) AS pr, count(*) OVER (PARTITION BY product, channel) AS n FROM cands) WHERE pr = 1""")
def d16_alerts(spark, sf):
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    return D.alerts(D.candidates(D.verdicts(grid, tests), tests), END).withColumn("delta", F.round("delta", 9))


PRIOR = "SELECT product, aspect AS main_aspect, channel, day AS window_end, CAST(k AS DOUBLE) / 100 AS rate, k % 5 = 0 AS resolved FROM voc WHERE day < DATE '2024-01-30' AND sentiment = -1"


@query(f""", prior AS ({PRIOR}), new AS (SELECT product, aspect AS main_aspect, channel, day AS window_end, max(CAST(k AS DOUBLE) / 100) AS rate FROM voc WHERE day = DATE '2024-01-30' GROUP BY ALL),
l AS (SELECT product, main_aspect, channel, max_by(window_end, (window_end, rate)) AS lw, max_by(rate, (window_end, rate)) AS lr FROM prior WHERE NOT resolved GROUP BY ALL)
SELECT new.product, new.main_aspect, new.channel, CASE WHEN lw IS NULL OR date_diff('day', lw, window_end) >= 7 THEN 'publish' WHEN rate - lr >= 0.05 - 1e-9 THEN 'update' ELSE 'suppress' END AS decision
FROM new LEFT JOIN l USING (product, main_aspect, channel)""")
def d17_suppression(spark, sf):
    docs = documents(spark, sf).withColumn("rate", F.col("k").cast("double") / 100)
    prior = docs.where((F.col("day") < END) & (F.col("sentiment") == -1)).select("product", F.col("aspect").alias("main_aspect"), "channel", F.col("day").alias("window_end"), "rate", (F.col("k") % 5 == 0).alias("resolved"))
    new = docs.where(F.col("day") == END).groupBy("product", F.col("aspect").alias("main_aspect"), "channel", F.col("day").alias("window_end")).agg(F.max("rate").alias("rate"))
    return D.suppress(new, prior).select("product", "main_aspect", "channel", "decision")


@query("SELECT product, channel, source, day, count(*) AS documents, count(DISTINCT CASE WHEN k % 9 <> 0 THEN item_id END) AS classified FROM voc GROUP BY ALL HAVING classified < documents", dates=("day",))
def a06_coverage(spark, sf):
    rows = documents(spark, sf).groupBy("product", "channel", "source", "day").agg(F.count("*").alias("documents"), F.countDistinct(F.when(F.col("k") % 9 != 0, F.col("item_id"))).alias("classified"))
    return rows.where("classified < documents")


@query("SELECT source, coalesce(CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v1' ELSE 'v2' END, 'none') AS version, count(*) AS n, count(*) FILTER ((CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v1' ELSE 'v2' END) IS DISTINCT FROM 'v2') AS stale FROM voc GROUP BY ALL")
def a09_versions(spark, sf):
    version = F.when(F.col("k") % 4 == 0, None).when(F.col("k") % 4 == 1, "v1").otherwise("v2")
    docs = documents(spark, sf).withColumn("v", version)
    return docs.groupBy("source", F.coalesce("v", F.lit("none")).alias("version")).agg(F.count("*").alias("n"), F.count_if(~F.col("v").eqNullSafe("v2")).alias("stale"))


@query("SELECT CASE WHEN product = 'P012' THEN 'unmapped product' WHEN channel = 'ZIGZAG' AND k < 10 THEN 'bad channel' ELSE 'kept' END AS reason, count(*) AS n FROM voc GROUP BY ALL")
def a12_drop_reasons(spark, sf):
    kept, dropped = S.quarantine(documents(spark, sf), {"unmapped product": F.col("product") == "P012", "bad channel": (F.col("channel") == "ZIGZAG") & (F.col("k") < 10)})
    return kept.withColumn("reason", F.lit("kept")).unionByName(dropped).groupBy("reason").agg(F.count("*").alias("n"))


RATIOS = """, m AS (SELECT product, CAST(date_trunc('month', day) AS DATE) AS month, aspect, count(*) FILTER (sentiment = 1) AS pos, count(*) FILTER (sentiment = 0) AS neu, count(*) FILTER (sentiment = -1) AS neg FROM voc GROUP BY ALL)
"""


@query(RATIOS + "SELECT product, month, aspect, pos, neu, neg, round(pos / (pos + neu + neg), 9) AS pos_ratio, round(neu / (pos + neu + neg), 9) AS neu_ratio, round(neg / (pos + neu + neg), 9) AS neg_ratio FROM m", dates=("month",))
def a17_ratios(spark, sf):
    rows = M.sentiment_ratios(documents(spark, sf))
    return rows.withColumns({c: F.round(c, 9) for c in ("pos_ratio", "neu_ratio", "neg_ratio")})


def order_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as opinions over many months: brand of the customer's segment as product, status as sentiment."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    sentiment = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    return o.select(F.concat(F.lit("P"), F.col("o_custkey") % 5).alias("product"), F.col("o_orderdate").cast("date").alias("day"), F.substring("o_orderpriority", 1, 1).alias("aspect"), sentiment.alias("sentiment"))


@query(""", o AS (SELECT 'P' || (o_custkey % 5) AS product, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, substr(o_orderpriority, 1, 1) AS aspect, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM orders GROUP BY ALL)
SELECT a.product, a.month, a.aspect, round(a.r - coalesce(b.r, 0), 7) AS drift, CASE WHEN a.r - coalesce(b.r, 0) >= 0.03 THEN 'RISK' ELSE 'SAFE' END AS status
FROM o a LEFT JOIN o b ON a.product = b.product AND a.aspect = b.aspect AND a.month = b.month + INTERVAL 1 MONTH""", dates=("month",))
def a18_drift(spark, sf):
    return M.drift(M.sentiment_ratios(order_documents(spark, sf))).withColumn("drift", F.round("drift", 7))


@query(""", l AS (SELECT p_brand AS product, ['COUPANG', 'NAVER', 'ZIGZAG', 'OTHER'][p_partkey % 4 + 1] AS channel, p_name AS name FROM part),
c AS (SELECT *, count(*) AS n FROM l GROUP BY ALL), t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY product, channel ORDER BY n DESC, name DESC) = 1),
v AS (SELECT product, name, count(*) AS votes, min((CASE channel WHEN 'ZIGZAG' THEN 0 WHEN 'NAVER' THEN 1 WHEN 'COUPANG' THEN 2 ELSE 3 END, channel)) AS best FROM t GROUP BY ALL)
SELECT product, name AS product_name FROM v QUALIFY row_number() OVER (PARTITION BY product ORDER BY votes DESC, best) = 1""")
def a19_product_names(spark, sf):
    channel = F.element_at(F.array(*map(F.lit, ("COUPANG", "NAVER", "ZIGZAG", "OTHER"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return M.product_names(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("product"), channel.alias("channel"), F.col("p_name").alias("name")))


@query(""", c AS (SELECT product, channel, aspect, count(*) AS n FROM voc WHERE sentiment = -1 GROUP BY ALL),
g AS (SELECT p.product, x.a AS channel_a, x.b AS channel_b, z.aspect FROM (SELECT DISTINCT product FROM voc) p CROSS JOIN (VALUES ('COUPANG', 'NAVER'), ('COUPANG', 'ZIGZAG'), ('NAVER', 'ZIGZAG')) x(a, b) CROSS JOIN (SELECT DISTINCT aspect FROM voc) z),
q AS (SELECT g.*, coalesce(ca.n, 0) AS x, coalesce(cb.n, 0) AS y FROM g LEFT JOIN c ca ON ca.product = g.product AND ca.channel = g.channel_a AND ca.aspect = g.aspect LEFT JOIN c cb ON cb.product = g.product AND cb.channel = g.channel_b AND cb.aspect = g.aspect),
s AS (SELECT *, sum(x) OVER w AS sx, sum(y) OVER w AS sy FROM q WINDOW w AS (PARTITION BY product, channel_a, channel_b))
SELECT product, channel_a, channel_b, CAST(max(sx) AS BIGINT) AS n_a, CAST(max(sy) AS BIGINT) AS n_b, CASE WHEN least(max(sx), max(sy)) < 1 THEN 'EMPTY_CHANNEL' WHEN max(sx + sy) < 30 THEN 'INSUFFICIENT_SAMPLE' END AS hold_reason,
  CASE WHEN least(max(sx), max(sy)) >= 1 AND max(sx + sy) >= 30 THEN round(sum(CASE WHEN x > 0 THEN x / sx * log2((x / sx) / ((x / sx + y / sy) / 2)) ELSE 0 END + CASE WHEN y > 0 THEN y / sy * log2((y / sy) / ((x / sx + y / sy) / 2)) ELSE 0 END) / 2, 9) END AS jsd
FROM s GROUP BY product, channel_a, channel_b""")
def t10_divergence(spark, sf):
    return M.channel_divergence(documents(spark, sf)).withColumn("jsd", F.round("jsd", 9))


@query("SELECT product, channel, n, round((hits / n + z / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + z / (4 * n * n))) / (1 + z / n), 9) AS low, round((hits / n + z / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + z / (4 * n * n))) / (1 + z / n), 9) AS high FROM (SELECT product, channel, count(*) AS n, CAST(count(*) FILTER (sentiment = -1) AS DOUBLE) AS hits, 1.96 * 1.96 AS z FROM voc GROUP BY ALL)")
def a31_wilson(spark, sf):
    rows = documents(spark, sf).groupBy("product", "channel").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") == -1).alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return rows.select("product", "channel", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(", c AS (SELECT product, aspect AS cause, count(*) AS n, min(item_id) AS first FROM voc WHERE sentiment = -1 GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY product) AS total FROM c) SELECT product, cause, n, CAST(total AS BIGINT) AS total, n / total >= 0.5 AND n >= 5 AS consistent FROM t QUALIFY row_number() OVER (PARTITION BY product ORDER BY n DESC, first) = 1")
def a20_top_cause(spark, sf):
    rows = documents(spark, sf).where("sentiment = -1").groupBy("product", F.col("aspect").alias("cause")).agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    whole = Window.partitionBy("product")
    rows = rows.withColumn("total", F.sum("n").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "first"))).where("r = 1")
    return rows.select("product", "cause", "n", "total", ((F.col("n") / F.col("total") >= C.CONSISTENT_RATIO) & (F.col("n") >= C.CONSISTENT_COUNT)).alias("consistent"))


@query(""", d AS (SELECT product, channel, aspect, day, count(*) FILTER (sentiment = -1) AS n, count(*) AS total FROM voc GROUP BY product, channel, aspect, day
), r AS (SELECT product, channel, aspect, min(day) AS lo, max(day) AS hi FROM d GROUP BY product, channel, aspect
), s AS (SELECT product, channel, aspect, CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM r
), f AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(n * 4 > total, FALSE) AS hit FROM s LEFT JOIN d USING (product, channel, aspect, day))
SELECT product, channel, aspect, day, n, CAST(count(*) FILTER (hit) OVER (PARTITION BY product, channel, aspect ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW) = 3 AS INTEGER) AS persistent FROM f""", dates=("day",))
def t18_persistence(spark, sf):
    """Slots small enough that some days have no document."""
    slot = ["product", "channel", "aspect"]
    rows = documents(spark, sf).groupBy(*slot, "day").agg(F.count_if(F.col("sentiment") == -1).alias("n"), F.count("*").alias("total"))
    dense = trends.persistence(rows, slot, F.coalesce(F.col("n") * 4 > F.col("total"), F.lit(False)), 3)
    return dense.select(*slot, "day", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("persistent").cast("int").alias("persistent"))


@query("SELECT item_id, occurred_at FROM voc WHERE (occurred_at, item_id) > (TIMESTAMP '2024-01-10 00:00:00', 100) ORDER BY occurred_at, item_id LIMIT 500")
def w05_keyset_page(spark, sf):
    return S.page_after(documents(spark, sf).select("item_id", "occurred_at"), "occurred_at", "item_id", ("2024-01-10 00:00:00", 100), 500)


@query("SELECT item_id, 'new' AS state, CAST(k + 100 AS INTEGER) AS value FROM voc WHERE k % 3 = 0 UNION ALL SELECT item_id, 'old', CAST(k AS INTEGER) FROM voc WHERE k % 2 = 0 AND k % 3 <> 0")
def k01_upsert(spark, sf):
    docs = documents(spark, sf)
    old = docs.where("k % 2 = 0").select("item_id", F.lit("old").alias("state"), F.col("k").alias("value"))
    return S.upsert(old, docs.where("k % 3 = 0").select("item_id", F.lit("new").alias("state"), (F.col("k") + 100).alias("value")), ["item_id"])


@query("SELECT item_id, CASE WHEN k % 3 = 0 THEN 'timeout' ELSE 'parse' END AS error, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN k % 2 = 0 THEN DATE '2024-01-01' ELSE day END AS first_failed_at, CASE WHEN k % 3 = 0 THEN day ELSE DATE '2024-01-01' END AS last_failed_at FROM voc WHERE k % 2 = 0 OR k % 3 = 0", dates=("first_failed_at", "last_failed_at"))
def k03_dead_letters(spark, sf):
    docs, first = documents(spark, sf), F.lit("2024-01-01").cast("date")
    letters = docs.where("k % 2 = 0").select("item_id", F.lit("parse").alias("error"), F.lit(2).alias("attempts"), first.alias("first_failed_at"), first.alias("last_failed_at"))
    return S.record_failures(letters, docs.where("k % 3 = 0").select("item_id", F.lit("timeout").alias("error"), F.col("day").alias("at")))


@query("SELECT label, count(*) FILTER (pred AND gold) AS tp, count(*) FILTER (pred AND NOT gold) AS fp, count(*) FILTER (NOT pred AND gold) AS fn, round(count(*) FILTER (pred AND gold) / nullif(count(*) FILTER (pred), 0), 9) AS precision, round(count(*) FILTER (pred AND gold) / nullif(count(*) FILTER (gold), 0), 9) AS recall FROM (SELECT 'quality' AS label, quality = 1 AS gold, n_chars > 500 AS pred FROM labels JOIN documents USING (doc_id)) GROUP BY label")
def e01_precision_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    rows = rows.select(F.lit("quality").alias("label"), (F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 500).alias("pred"))
    out = rows.groupBy("label").agg(F.count_if(F.col("pred") & F.col("gold")).alias("tp"), F.count_if(F.col("pred") & ~F.col("gold")).alias("fp"), F.count_if(~F.col("pred") & F.col("gold")).alias("fn"))
    return out.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 9))


@query("SELECT md5(lower(text)) AS text_id, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL HAVING count(*) > 1")
def a35_exact_duplicates(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").groupBy(F.md5(F.lower("text")).alias("text_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 3")
def v01_filtered_nearest(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return nearest(queries, e, 3).select("query_id", "vec_id", "rank")


@query("SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 3")
def v01_indexed_nearest(spark, sf):
    """The same through an index of pivots and rings."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return nearest_indexed(queries, index(e), 3)[0].select("query_id", "vec_id", "rank")


@query("SELECT product, aspect FROM voc WHERE source = 'cs' GROUP BY ALL EXCEPT SELECT product, aspect FROM voc WHERE source = 'review' GROUP BY ALL")
def u03_difference(spark, sf):
    pairs = documents(spark, sf).select("product", "aspect", "source")
    return pairs.where("source = 'cs'").select("product", "aspect").distinct().join(pairs.where("source = 'review'"), ["product", "aspect"], "left_anti")


@query("SELECT item_id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(CAST(extract('milliseconds' FROM occurred_at) AS INTEGER) % 1000 AS VARCHAR), 3, '0') || 'Z' AS at FROM voc")
def y06_iso_millis(spark, sf):
    return documents(spark, sf).select("item_id", F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+(,[0-9]{3})*(\\.[0-9]+)?')) AS numbers, md5(lower(regexp_replace(text, '[^\\p{L}\\p{N}_]+', '', 'g'))) AS normal FROM documents")
def x01_normalise_numbers(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"([0-9]+(,[0-9]{3})*(\.[0-9]+)?)"), 1)).cast("long").alias("numbers"), F.md5(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}_]+", ""))).alias("normal"))


@query("SELECT product, item_id FROM voc QUALIFY row_number() OVER (PARTITION BY product ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) <= greatest(1, CAST(round_even(200.0 * count(*) OVER (PARTITION BY product) / count(*) OVER (), 0) AS BIGINT))")
def w09_stratified_sample(spark, sf):
    docs = documents(spark, sf).select("product", "item_id")
    sizes = docs.groupBy("product").agg(F.count("*").alias("n"))
    quota = sizes.join(F.broadcast(docs.agg(F.count("*").alias("all"))), how="cross").select("product", F.greatest(F.lit(1), F.bround(200.0 * F.col("n") / F.col("all"))).alias("quota"))
    place = lambda *by: F.row_number().over(Window.partitionBy("product", *by).orderBy(F.md5(F.col("item_id").cast("string")), "item_id"))
    part = F.pmod(F.xxhash64("item_id"), F.lit(64))  # no part gives more than the quota, so that no stratum is sorted as a whole
    first = docs.withColumn("part", part).withColumn("r", place("part")).join(quota, "product").where("r <= quota")
    return first.withColumn("r", place()).where("r <= quota").select("product", "item_id")


@query(", s AS (SELECT CAST(d AS DATE) AS window_end FROM range(DATE '2024-01-14', DATE '2024-01-31', INTERVAL 1 DAY) r(d)) SELECT s.window_end, product, count(*) FILTER (date_diff('day', day, s.window_end) < 7) AS current, count(*) FILTER (date_diff('day', day, s.window_end) >= 7) AS past FROM s JOIN voc ON date_diff('day', voc.day, s.window_end) BETWEEN 0 AND 34 GROUP BY ALL", dates=("window_end",))
def w03_sliding_windows(spark, sf):
    days = documents(spark, sf).groupBy("product", "day").agg(F.count("*").alias("n"))  # a row for each product and day
    ends = F.explode(F.sequence(F.greatest("day", F.lit("2024-01-14").cast("date")), F.least(F.date_add("day", 34), F.lit(END).cast("date"))))
    spread = days.where(F.col("day") <= END).withColumn("window_end", ends)
    now = F.datediff("window_end", "day") < 7
    return spread.groupBy("window_end", "product").agg(F.sum(F.when(now, F.col("n")).otherwise(0)).alias("current"), F.sum(F.when(~now, F.col("n")).otherwise(0)).alias("past"))


@query()
def t11_permutation(spark, sf):
    pairs = M.channel_pairs(documents(spark, sf))
    tests = M.permutation_test(pairs.where("hold_reason IS NULL"))
    rows = pairs.drop("x", "y").join(tests, ["product", "channel_a", "channel_b"], "left")
    return M.finalized(rows)


#: Opinions (no neutral ones) of two channels on one product and day by attribute: few enough to go through all tables.
DAY_PAIRS = """, c AS (
  SELECT product || ' ' || strftime(day, '%Y-%m-%d') AS product, channel, [count(*) FILTER (aspect = '색상'), count(*) FILTER (aspect = '사이즈'), count(*) FILTER (aspect = '소재'), count(*) FILTER (aspect = '파손'), count(*) FILTER (aspect = '오배송'), count(*) FILTER (aspect = '기타')] AS v
  FROM voc WHERE sentiment <> 0 GROUP BY product || ' ' || strftime(day, '%Y-%m-%d'), channel
), p AS (
  SELECT a.product, a.channel AS channel_a, b.channel AS channel_b, a.v AS x, list_sum(a.v) AS n, list_sum(b.v) AS o, list_transform(range(1, 7), lambda i: a.v[i] + b.v[i]) AS m FROM c a JOIN c b ON a.product = b.product AND a.channel < b.channel
), t AS (
  SELECT product, channel_a, channel_b, n, o, m, x = z AS own, z FROM (SELECT *, [a.k, b.k, c.k, d.k, e.k, n - a.k - b.k - c.k - d.k - e.k] AS z FROM p, range(0, m[1] + 1) a(k), range(0, m[2] + 1) b(k), range(0, m[3] + 1) c(k), range(0, m[4] + 1) d(k), range(0, m[5] + 1) e(k)) WHERE z[6] BETWEEN 0 AND m[6]
), f AS (
  SELECT *, exp(list_sum(list_transform(range(1, 7), lambda i: lgamma(m[i] + 1) - lgamma(z[i] + 1) - lgamma(m[i] - z[i] + 1))) - lgamma(n + o + 1) + lgamma(n + 1) + lgamma(o + 1)) AS w,
    list_sum(list_transform(range(1, 7), lambda i: (CASE WHEN z[i] > 0 THEN z[i] / n * log2(2 * z[i] / n / (z[i] / n + (m[i] - z[i]) / o)) ELSE 0 END + CASE WHEN m[i] > z[i] THEN (m[i] - z[i]) / o * log2(2 * (m[i] - z[i]) / o / (z[i] / n + (m[i] - z[i]) / o)) ELSE 0 END) / 2)) AS d FROM t
), s AS (SELECT product, channel_a, channel_b, max(d) FILTER (own) AS seen FROM f GROUP BY ALL)
"""


@query(DAY_PAIRS + "SELECT product, channel_a, channel_b, round(any_value(seen), 4) AS jsd, round(sum(w * d), 4) AS baseline, round(sum(w) FILTER (d >= seen - 1e-10), 4) AS p_value FROM f JOIN s USING (product, channel_a, channel_b) GROUP BY product, channel_a, channel_b")
def t11_exact(spark, sf):
    """The permutation test of six attributes over all tables of a pair's margins."""
    counts = F.array(*(F.count_if(F.col("aspect") == a) for a in C.ASPECTS))
    name = F.concat_ws(" ", "product", F.date_format("day", "yyyy-MM-dd"))
    rows = documents(spark, sf).where("sentiment <> 0").groupBy(name.alias("product"), "channel").agg(counts.alias("v"))
    pairs = rows.toDF("product", "channel_a", "x").join(rows.toDF("product", "channel_b", "y"), "product").where("channel_a < channel_b")
    tested = M.tested_pairs(pairs)
    return tested.select("product", "channel_a", "channel_b", *(F.round(c, 4).alias(c) for c in ("jsd", "baseline", "p_value")))


@query(GRID + """, x AS (SELECT DISTINCT product, channel, day FROM w WHERE NOT now AND k < 30), g AS (
  SELECT w.product, w.channel, w.source, '색상' AS aspect, count(*) AS gt, count(*) FILTER (sentiment = -1 AND w.aspect = '색상') AS gn FROM w JOIN x USING (product, channel, day) WHERE NOT now GROUP BY ALL
), f AS (SELECT grid.*, past_total - coalesce(gt, 0) AS pt, past_neg - coalesce(gn, 0) AS pn FROM grid LEFT JOIN g USING (product, channel, source, aspect))
SELECT product, channel, source, aspect, CASE WHEN pt = 0 THEN cur_total * 4 ELSE pt END AS past_total,
  CASE WHEN pt = 0 THEN CAST(round_even(0.05 * cur_total * 4, 0) AS BIGINT) WHEN pt * 2 <= past_total THEN CAST(round_even(0.05 * pt, 0) AS BIGINT) ELSE pn END AS past_neg FROM f""")
def a05_baseline_fallback(spark, sf):
    docs = documents(spark, sf)
    age = F.datediff(F.lit(END).cast("date"), F.col("day"))
    gone = docs.where((F.col("k") < 30) & age.between(7, 34)).select("product", F.lit("색상").alias("aspect"), "channel", "day")
    grid = D.slots(docs, END, gone).withColumn("fallback_rate", F.lit(0.05))
    return D.baseline_fallback(grid).select("product", "channel", "source", "aspect", "past_total", "past_neg")


@query("SELECT gold, pred, count(*) AS n FROM (SELECT toxic AS gold, CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def e07_confusion(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id")
    pred = F.when(F.contains(F.lower("text"), F.lit("idiot")), 1).otherwise(0)
    return rows.groupBy(F.col("toxic").alias("gold"), pred.alias("pred")).agg(F.count("*").alias("n"))


@query("SELECT product, day, vote, n, n = total AS agreed FROM (SELECT product, day, aspect AS vote, count(*) AS n, min(item_id) AS first, sum(count(*)) OVER (PARTITION BY product, day) AS total FROM voc GROUP BY product, day, aspect) QUALIFY row_number() OVER (PARTITION BY product, day ORDER BY n DESC, first) = 1", dates=("day",))
def a36_majority_vote(spark, sf):
    votes = documents(spark, sf).groupBy("product", "day", F.col("aspect").alias("vote")).agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    whole = Window.partitionBy("product", "day")
    rows = votes.withColumn("agreed", F.col("n") == F.sum("n").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "first")))
    return rows.where("r = 1").select("product", "day", "vote", "n", "agreed")


@query("SELECT product, day, aspect, sentiment, CAST(sentiment < 0 AS BOOLEAN) AS any_negative, mixed FROM (SELECT product, day, aspect, CASE WHEN min(sentiment) = -1 THEN -1 WHEN max(sentiment) = 1 THEN 1 ELSE 0 END AS sentiment, count(DISTINCT sentiment) > 1 AS mixed FROM voc GROUP BY product, day, aspect)", dates=("day",))
def z08_polarity_merge(spark, sf):
    s = F.when(F.min("sentiment") == -1, -1).when(F.max("sentiment") == 1, 1).otherwise(0)
    rows = documents(spark, sf).groupBy("product", "day", "aspect").agg(s.alias("sentiment"), (F.countDistinct("sentiment") > 1).alias("mixed"))
    return rows.select("product", "day", "aspect", "sentiment", (F.col("sentiment") < 0).alias("any_negative"), "mixed")


@query("SELECT product, day, start FROM (SELECT product, day, min(day) OVER (PARTITION BY product, day - CAST(r AS INTEGER)) AS start FROM (SELECT product, day, row_number() OVER (PARTITION BY product ORDER BY day) AS r FROM (SELECT product, day FROM voc GROUP BY product, day HAVING count(*) FILTER (sentiment = -1) * 5 > count(*))))", dates=("day", "start"))
def t19_streaks(spark, sf):
    days = documents(spark, sf).groupBy("product", "day").agg(F.count_if(F.col("sentiment") == -1).alias("neg"), F.count("*").alias("n")).where("neg * 5 > n").select("product", "day")
    rows = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("product").orderBy("day"))))
    return rows.select("product", "day", F.min("day").over(Window.partitionBy("product", "island")).alias("start"))


@query(TESTS + f""", pb AS (SELECT product, channel AS pc, source AS ps, aspect AS pa, fired AS before, unnest([-1, 1]) AS step FROM tests
), x AS (
  SELECT t.product, pc, ps, pa, step, before, channel = pc AND source = ps AND aspect = pa AS own, CASE WHEN channel = pc AND source = ps AND aspect = pa THEN least(greatest(cur_neg + step, 0), cur_total) ELSE cur_neg END AS cur_neg, cur_total, past_neg, past_total
  FROM tests t JOIN pb ON t.product = pb.product
), y AS (SELECT *, {FISHER} AS p_value FROM x
), z AS (
  SELECT *, count(*) OVER (PARTITION BY product, pc, ps, pa, step ORDER BY p_value) AS r, count(*) OVER (PARTITION BY product, pc, ps, pa, step) AS m FROM y
), u AS (
  SELECT *, coalesce(r <= max(CASE WHEN p_value <= CAST(r AS DOUBLE) / m * CAST(0.05 AS DOUBLE) THEN r END) OVER (PARTITION BY product, pc, ps, pa, step), FALSE) AS sig FROM z
) SELECT product, pc AS channel, ps AS source, pa AS aspect, step, before, sig AND CAST(cur_neg AS DOUBLE) / cur_total - CAST(past_neg AS DOUBLE) / past_total >= 0.03 AS after FROM u WHERE own""")
def t15_robustness(spark, sf):
    return D.robustness(tests_of(spark, sf))


@query(", one AS (SELECT 1), dv AS (SELECT *, CASE WHEN jsd < 0.1 THEN 0 WHEN jsd < 0.2 THEN 1 WHEN jsd IS NOT NULL THEN 2 END AS rank FROM (" + SQL["t10_divergence"] + """)), w AS (SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY product ORDER BY rank DESC NULLS LAST, jsd DESC NULLS LAST, channel_a, channel_b) = 1)
SELECT product, CASE WHEN w.rank IS NULL THEN '' ELSE channel_a || '-' || channel_b END AS pair, ['SAFE', 'CAUTION', 'CRISIS'][w.rank + 1] AS severity, (SELECT bool_or(rank > 0) FROM dv WHERE dv.product = w.product) AS crisis FROM w""")
def a25_rollup(spark, sf):
    pairs = M.channel_divergence(documents(spark, sf)).withColumn("excess", F.round("jsd", 9))
    level = F.when(F.col("jsd").isNotNull(), M.severity(F.col("excess"), F.lit(0.0), F.lit(True)))
    return M.divergence_rollup(pairs.withColumn("severity", level))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def s13_repeated_keys(spark, sf):
    return S.repeated_keys(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey", "o_orderpriority"])


@query("SELECT item_id, concat_ws(';', CASE WHEN k > 90 THEN 'count over total' END, CASE WHEN k % 3 = 0 THEN 'ratios' END, CASE WHEN k % 5 = 0 THEN 'both ids' END) AS errors FROM voc")
def z11_constraints(spark, sf):
    k = F.col("k")
    ratio = F.when(k % 3 == 0, 0.4).otherwise(0.5)
    first, second = F.lit("a"), F.when(k % 5 == 0, "b")
    checks = [("count over total", k > 90), ("ratios", F.abs(ratio + 0.5 - 1) > 1e-6), ("both ids", first.isNotNull() & second.isNotNull())]
    return documents(spark, sf).select("item_id", F.concat_ws(";", V.errors(checks)).alias("errors"))
