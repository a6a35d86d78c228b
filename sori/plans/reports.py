"""Queries of tests' parts, verdicts' parts, proposals, reports, feedback and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import stats, text, times
from sori.operators import detection as D
from sori.operators import grounding as G
from sori.operators import monthly as M
from sori.operators import outputs as O
from sori.operators import reports as R
from sori.operators import validation as V
from sori.operators.nearest import nearest
from sori.plans.lookups import rows_n, table
from sori.plans.queries import CANDIDATES, FISHER, GRID, TESTS, VERDICTS, grid_of, tests_of
from sori.plans.registry import END, query
from sori.sources.voc import documents

KEY = ["product", "channel", "source", "aspect"]


@query(TESTS + "SELECT product, channel, source, aspect, round(delta, 9) AS delta, delta >= 0.03 AS meaningful FROM tests")
def t02_delta(spark, sf):
    return tests_of(spark, sf).select(*KEY, F.round("delta", 9).alias("delta"), "meaningful")


@query(GRID + """, u AS (SELECT DISTINCT product, channel, source FROM voc WHERE k = 13 AND source = 'review' AND product < 'P006')
SELECT h.product, h.channel, h.source, h.aspect, CASE WHEN hold = 'small_sample' THEN hold WHEN u.product IS NOT NULL THEN 'unreliable' ELSE hold END AS hold FROM holds h LEFT JOIN u USING (product, channel, source)""")
def t03_holds(spark, sf):
    docs = documents(spark, sf)
    unreliable = docs.where("k = 13 AND source = 'review' AND product < 'P006'").select("product", "channel", "source")
    return D.held_slots(D.slots(docs, END), unreliable).select(*KEY, "hold")


@query(TESTS + "SELECT product, channel, source, aspect FROM tests WHERE fired")
def t06_fired(spark, sf):
    return tests_of(spark, sf).where("fired").select(*KEY)


@query(TESTS + """, fam AS (SELECT *, count(*) OVER (ORDER BY p_value) AS r1, count(*) OVER () AS m1 FROM p)
SELECT product, channel, source, aspect, coalesce(r1 <= max(CASE WHEN p_value <= CAST(r1 AS DOUBLE) / m1 * CAST(0.05 AS DOUBLE) THEN r1 END) OVER (), FALSE) AS bh_significant FROM fam""")
def t08_one_family(spark, sf):
    return D.tested(grid_of(spark, sf), ()).select(*KEY, "bh_significant")


@query(TESTS + "SELECT product, channel, source, aspect, r AS rank, m AS family FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY p_value, channel, source, aspect_no) AS r, count(*) OVER (PARTITION BY product) AS m FROM p)".replace("p_value, channel", "round(p_value, 12), channel"))
def w01_ranks(spark, sf):
    tests = tests_of(spark, sf)
    whole = Window.partitionBy("product")
    rank = F.row_number().over(whole.orderBy(F.round("p_value", 12), "channel", "source", "aspect_no"))
    return tests.select(*KEY, rank.cast("long").alias("rank"), F.count("*").over(whole).alias("family"))


@query("SELECT n_name, CASE WHEN least(a, b) < 1 THEN 'EMPTY_CHANNEL' WHEN a + b < 30 THEN 'INSUFFICIENT_SAMPLE' END AS hold_reason FROM (SELECT n_name, n_nationkey % 7 * 5 AS a, n_nationkey % 5 * 6 AS b FROM nation)")
def t12_gate(spark, sf):
    a, b = F.col("n_nationkey") % 7 * 5, F.col("n_nationkey") % 5 * 6
    return table(spark, sf, "nation").select("n_name", M.divergence_gate(a, b).alias("hold_reason"))


@query("SELECT item_id, CASE WHEN k % 3 = 0 OR (k - k % 7) * 4 < 100 THEN 'SAFE' WHEN (k - k % 7) * 4 < 200 THEN 'CAUTION' ELSE 'CRISIS' END AS severity FROM voc")
def t13_severity(spark, sf):
    k = F.col("k")
    jsd, baseline = (k * 4).cast("double") / 1000 + 1e-12, (k % 7 * 4).cast("double") / 1000
    return documents(spark, sf).select("item_id", M.severity(jsd, baseline, k % 3 != 0).alias("severity"))


def _bits(a: str, b: str) -> str:
    def term(x: str, n: str) -> str:
        return f"CASE WHEN {x} > 0 THEN {x} / {n} * log2(({x} / {n}) / (({a} / na + {b} / nb) / 2)) ELSE 0 END + CASE WHEN {n} - {x} > 0 THEN ({n} - {x}) / {n} * log2((({n} - {x}) / {n}) / ((({'na - ' + a}) / na + ({'nb - ' + b}) / nb) / 2)) ELSE 0 END"

    return f"(({term(a, 'na')} + {term(b, 'nb')}) / 2)"


def _lc(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query(f""", c AS (SELECT product, channel, CAST(count(*) FILTER (sentiment = -1) AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM voc GROUP BY ALL
), q AS (SELECT a.product, a.channel AS channel_a, b.channel AS channel_b, a.x AS x, b.x AS y, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.product = b.product AND a.channel < b.channel
), hq AS (SELECT *, CASE WHEN na + nb < 60 THEN 'INSUFFICIENT_SAMPLE' END AS hold_reason, {_bits('x', 'y')} AS jsd FROM q
), en AS (SELECT *, unnest(range(CAST(greatest(0, na + x + y - na - nb) AS BIGINT), CAST(least(na, x + y) AS BIGINT) + 1))::DOUBLE AS j FROM hq WHERE hold_reason IS NULL
), w AS (SELECT *, exp({_lc('(x + y)', 'j')} + {_lc('(na + nb - x - y)', '(na - j)')} - {_lc('(na + nb)', 'na')}) AS w, {_bits('j', '(x + y - j)')} AS d FROM en
), t AS (SELECT product, channel_a, channel_b, any_value(jsd) AS jsd, sum(w * d) AS baseline, least(1.0, sum(w) FILTER (d >= jsd - 1e-12)) AS p_value FROM w GROUP BY ALL
), r AS (SELECT *, count(*) OVER (ORDER BY p_value) AS r, count(*) OVER () AS m FROM t
), s AS (SELECT *, coalesce(r <= max(CASE WHEN p_value <= CAST(r AS DOUBLE) / m * CAST(0.05 AS DOUBLE) THEN r END) OVER (), FALSE) AS sig FROM r)
SELECT hq.product, hq.channel_a, hq.channel_b, hq.hold_reason, round(s.p_value, 5) AS p_value, round(s.jsd - s.baseline, 5) AS excess, sig AS bh_significant,
  CASE WHEN s.jsd IS NULL THEN NULL WHEN NOT sig OR s.jsd - s.baseline < 0.1 THEN 'SAFE' WHEN s.jsd - s.baseline < 0.2 THEN 'CAUTION' ELSE 'CRISIS' END AS severity
FROM hq LEFT JOIN s USING (product, channel_a, channel_b)""")
def t14_finalized(spark, sf):
    """Negative and other documents as two categories, tested by full enumeration."""
    rows = documents(spark, sf).groupBy("product", "channel").agg(F.count_if(F.col("sentiment") == -1).alias("x"), F.count("*").alias("n"))
    pairs = rows.toDF("product", "channel_a", "x", "na").join(rows.toDF("product", "channel_b", "y", "nb"), "product").where("channel_a < channel_b")
    pairs = pairs.withColumn("hold_reason", F.when(F.col("na") + F.col("nb") < 60, "INSUFFICIENT_SAMPLE"))
    baseline, p = M.exact_test(F.col("x"), F.col("y"), F.col("na"), F.col("nb"))
    double = lambda a, n: F.array(F.col(a).cast("double"), (F.col(n) - F.col(a)).cast("double"))
    tested = F.col("hold_reason").isNull()
    pairs = pairs.withColumns({"jsd": F.when(tested, stats.jensen_shannon_bits(double("x", "na"), double("y", "nb"))), "baseline": F.when(tested, baseline), "p_value": F.when(tested, p)})
    out = M.finalized(pairs)
    return out.select("product", "channel_a", "channel_b", "hold_reason", F.round("p_value", 5).alias("p_value"), F.round("excess", 5).alias("excess"), "bh_significant", "severity")


@query(", g AS (SELECT n_nationkey AS id, 20 * n_nationkey + 3 AS cur_neg, 1000 * (n_nationkey + 1) AS cur_total, 55 * n_nationkey + 11 AS past_neg, 4000 * (n_nationkey + 1) AS past_total FROM nation) SELECT id, round(" + FISHER + ", 7) AS p_value FROM g")
def t01_fisher_large(spark, sf):
    """Counts in the thousands, better and worse than the baseline."""
    i = F.col("n_nationkey").cast("long")
    p = stats.fisher_greater(i * 20 + 3, (i + 1) * 1000, i * 55 + 11, (i + 1) * 4000)
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.round(p, 7).alias("p_value"))


@query("""SELECT product, round(0.074 * r / nullif(0.074 * r + 0.926 * f, 0), 9) AS precision, CASE WHEN fp = 0 AND r > 0 THEN round(0.074 * r / (0.074 * r + 0.926 * 3 / n), 9) END AS lower FROM (
  SELECT product, count(*) FILTER (k % 2 = 0 AND k % 3 = 0 AND k > 20) AS fp, count(*) FILTER (sentiment = -1 AND k % 2 = 0) / count(*) FILTER (sentiment = -1) AS r, count(*) FILTER (sentiment <> -1) AS n,
    count(*) FILTER (sentiment <> -1 AND k % 2 = 0 AND k > 98) / count(*) FILTER (sentiment <> -1) AS f, FROM voc GROUP BY product)""".replace("count(*) FILTER (k % 2 = 0 AND k % 3 = 0 AND k > 20) AS fp", "count(*) FILTER (sentiment <> -1 AND k % 2 = 0 AND k > 98) AS fp"))
def t17_operational_precision(spark, sf):
    from sori.operators.evaluation import negative_table

    items = documents(spark, sf).select("product", (F.col("sentiment") == -1).alias("gold_negative"), ((F.col("k") % 2 == 0) & ((F.col("sentiment") == -1) | (F.col("k") > 98))).alias("pred_negative"))
    rows = negative_table(items, ["product"], 0.074)
    return rows.select("product", F.round("operational_precision", 9).alias("precision"), F.round("operational_lower", 9).alias("lower"))


@query(VERDICTS + "SELECT product, source, unnest(holding) AS channel FROM hc")
def d02_holding_channels(spark, sf):
    held = grid_of(spark, sf).where("hold IS NOT NULL")
    return held.select("product", "source", "channel").distinct()


@query(CANDIDATES + "SELECT source, product, channel, main_aspect FROM cands")
def d03_folded_candidates(spark, sf):
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    return D.candidates(D.verdicts(grid, tests), tests).select("source", "product", "channel", "main_aspect")


@query(CANDIDATES + "SELECT product, aspect, source, channel, round(max(delta), 9) AS delta FROM ff GROUP BY ALL")
def d04_representative_deltas(spark, sf):
    """The largest delta of the fired channels stands for a verdict on all of them."""
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    verdicts = D.verdicts(grid, tests).where(F.col("verdict") != C.NORMAL)
    whole = verdicts.where(F.col("verdict").isin(C.GLOBAL, C.TENTATIVE)).select("product", "aspect", "source", F.lit("ALL").alias("channel"), F.col("top_delta").alias("delta"))
    fired = verdicts.where(~F.col("verdict").isin(C.GLOBAL, C.TENTATIVE)).select("product", "aspect", "source", F.explode("channels").alias("channel"))
    own = fired.join(tests.select(*KEY, "delta"), KEY).select("product", "aspect", "source", "channel", "delta")
    return whole.unionByName(own).withColumn("delta", F.round("delta", 9))


@query(TESTS + "SELECT product, aspect, source, arg_min(channel, (-delta, channel)) AS stats_channel, round(max(delta), 9) AS delta FROM tests WHERE fired GROUP BY ALL")
def d05_stats_channels(spark, sf):
    return R.stats_channel(tests_of(spark, sf).where("fired")).withColumn("delta", F.round("delta", 9))


VERDICT = f"CASE k % 5 WHEN 0 THEN '{C.GLOBAL}' WHEN 1 THEN '{C.TENTATIVE}' WHEN 2 THEN '{C.INDETERMINATE}' ELSE '{C.BIASED}' END"


def verdict_of_k() -> F.Column:
    k = F.col("k") % 5
    return F.when(k == 0, C.GLOBAL).when(k == 1, C.TENTATIVE).when(k == 2, C.INDETERMINATE).otherwise(C.BIASED)


def _actions(consistent: str) -> str:
    a = C.ACTIONS
    return f"CASE WHEN k % 5 < 2 THEN '{a['product']}' WHEN k % 5 = 2 THEN '{a['undetermined']}' WHEN aspect = '파손' THEN '{a['파손']}' WHEN aspect = '오배송' THEN '{a['오배송']}' WHEN aspect = '기타' THEN '{a['기타']}' WHEN {consistent} THEN '{a['recommend']}' ELSE '{a['channel']}' END"


@query(f"SELECT item_id, {_actions('FALSE')} AS actions FROM voc")
def d07_sub_actions(spark, sf):
    rows = documents(spark, sf)
    subs = R.sub_actions(F.array("aspect"), F.create_map("aspect", verdict_of_k()))
    return rows.select("item_id", F.array_join(F.transform(subs, lambda s: s["action"]), ",").alias("actions"))


@query(f"SELECT item_id, CASE WHEN k % 5 < 2 THEN '{C.NOT_APPLICABLE}' WHEN k % 5 = 2 THEN '{C.MEDIUM}' WHEN k % 3 <> 1 THEN '{C.LOW}' WHEN k % 2 = 0 THEN '{C.HIGH}' ELSE '{C.MEDIUM}' END AS confidence FROM voc")
def d08_confidence(spark, sf):
    k = F.col("k")
    consistent = F.when(k % 3 == 0, None).otherwise(k % 3 == 1)
    return documents(spark, sf).select("item_id", D.confidence(verdict_of_k(), consistent, k % 2 == 0).alias("confidence"))


@query(f"SELECT item_id, {_actions('k % 3 = 1')} AS action FROM voc")
def d09_actions(spark, sf):
    consistent = F.when(F.col("k") % 3 == 0, None).otherwise(F.col("k") % 3 == 1)
    return documents(spark, sf).select("item_id", D.action(verdict_of_k(), F.col("aspect"), consistent).alias("action"))


@query(CANDIDATES + "SELECT product, channel, min(source) AS primary_source, count(DISTINCT source) AS sources FROM cands GROUP BY ALL")
def d11_primary_sources(spark, sf):
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    cands = D.candidates(D.verdicts(grid, tests), tests)
    sources = cands.groupBy("product", "channel").agg(F.countDistinct("source").alias("sources"))
    return D.alerts(cands, END).select("product", "channel", "primary_source").join(sources, ["product", "channel"])


@query(CANDIDATES + "SELECT DISTINCT 'ALT-20240130-' || product || '-' || CASE arg_min(main_aspect, source) OVER (PARTITION BY product, channel) WHEN '색상' THEN 'COLOR' WHEN '사이즈' THEN 'SIZE' WHEN '소재' THEN 'MATERIAL' WHEN '파손' THEN 'DAMAGE' WHEN '오배송' THEN 'MISDELIVERY' ELSE 'ETC' END || '-' || channel AS alert_id FROM cands".replace("SELECT DISTINCT 'ALT", "SELECT 'ALT").replace(" OVER (PARTITION BY product, channel)", "").replace("FROM cands", "FROM cands GROUP BY product, channel"))
def d13_alert_ids(spark, sf):
    grid = grid_of(spark, sf)
    tests = D.tested(grid)
    return D.alerts(D.candidates(D.verdicts(grid, tests), tests), END).select("alert_id")


@query(VERDICTS + f"SELECT product, source, aspect, CASE WHEN verdict IN ('{C.GLOBAL}', '{C.TENTATIVE}') THEN 'ALL' ELSE array_to_string(channels, ',') END AS channel FROM verdicts WHERE verdict <> '{C.NORMAL}'")
def d14_collapsed_channels(spark, sf):
    grid = grid_of(spark, sf)
    rows = D.verdicts(grid, D.tested(grid)).where(F.col("verdict") != C.NORMAL)
    return rows.select("product", "source", "aspect", F.when(F.col("verdict").isin(C.GLOBAL, C.TENTATIVE), "ALL").otherwise(F.concat_ws(",", "channels")).alias("channel"))


@query(f"SELECT item_id, CASE WHEN k % 4 = 0 THEN '' WHEN k % 2 = 1 THEN aspect || '/' || k || '/' || (k + 1) ELSE '{R.UNSPECIFIED}/' || k || '/' || (k + 1) END AS cause FROM voc")
def d15_root_causes(spark, sf):
    k = F.col("k")
    diagnosis = F.when(k % 4 != 0, F.struct(F.col("aspect").alias("label"), k.alias("count"), (k + 1).alias("total"), (k % 2 == 1).alias("consistent")))
    c = R.root_cause(diagnosis)
    return documents(spark, sf).select("item_id", F.concat_ws("/", c["label"], c["count"].cast("string"), c["total"].cast("string")).alias("cause"))


CAUSES = ", ci AS (SELECT item_id, product, k, aspect AS cause, k % 10 <> 3 AS aspect_match, k % 10 = 7 AS invalid FROM voc WHERE sentiment = -1 AND k % 11 <> 5)"


def diagnosed(spark, sf):
    rows = documents(spark, sf).where("sentiment = -1")
    items = rows.select("product", F.col("item_id").alias("cs_id"), F.col("item_id").alias("position"))
    k = F.col("k")
    results = rows.where("k % 11 <> 5").select(F.col("item_id").alias("cs_id"), F.col("aspect").alias("cause"), (k % 10 != 3).alias("aspect_match"), (k % 10 == 7).alias("invalid"))
    return items, results


@query(CAUSES + """, n AS (SELECT product, CASE WHEN NOT invalid THEN cause END AS cause, count(*) AS n FROM ci WHERE aspect_match OR invalid GROUP BY ALL), t AS (SELECT product, sum(n) AS total, coalesce(sum(n) FILTER (cause IS NULL), 0) AS invalid, max(n) FILTER (cause IS NOT NULL) AS most, min_by(cause, (-n, cause)) FILTER (cause IS NOT NULL) AS top FROM n GROUP BY product)
SELECT product, CASE WHEN most / total >= 0.5 AND most >= 5 THEN top END AS label, CASE WHEN most / total >= 0.5 AND most >= 5 THEN most ELSE 0 END AS count, CAST(total AS BIGINT) AS total, CAST(invalid AS BIGINT) AS invalid, coalesce(most / total >= 0.5 AND most >= 5, FALSE) AS consistent FROM t""")
def a21_cause_totals(spark, sf):
    return R.cause_totals(*diagnosed(spark, sf), ["product"])


@query(CAUSES + "SELECT product, item_id AS cs_id FROM ci WHERE aspect_match OR invalid")
def a21_cause_ids(spark, sf):
    return R.cause_ids(*diagnosed(spark, sf)).select("product", "cs_id")


@query(f"SELECT item_id, k % 6 <> 0 AND k % 2 = 0 AND k % 3 <> 1 AND k % 5 < 3 AS passed, concat_ws('; ', CASE WHEN k % 6 = 0 THEN 'no evidence' WHEN k % 2 <> 0 THEN 'not grounded' END, CASE WHEN k % 3 = 1 THEN 'inconsistent' END, CASE WHEN k % 5 >= 3 THEN 'not actionable' END) AS reasons FROM voc")
def d21_evaluated(spark, sf):
    k = F.col("k")
    proposal = F.when(k % 5 < 3, "상세 페이지를 확인하세요").otherwise("느낌이 다릅니다")
    r = R.evaluated(k % 2 == 0, k % 3 != 1, R.actionable(proposal), F.when(k % 6 == 0, R.NO_DETAIL).otherwise("원문"))
    return documents(spark, sf).select("item_id", r["passed"].alias("passed"), r["reasons"].alias("reasons"))


@query("SELECT item_id, CASE k % 4 WHEN 0 THEN '안정 단계' WHEN 1 THEN '주의 단계' WHEN 2 THEN '위험 단계' ELSE '안정 단계' END AS label, CASE WHEN k % 4 = 3 THEN '' ELSE concat_ws('; ', CASE WHEN NOT (k % 4 = k % 3) THEN 'missing ' || ['안정 단계', '주의 단계', '위험 단계'][k % 4 + 1] END, CASE WHEN k % 3 <> k % 4 THEN 'other ' || ['안정 단계', '주의 단계', '위험 단계'][k % 3 + 1] END) END AS errors FROM voc")
def d31_stage_labels(spark, sf):
    names = F.array(*map(F.lit, R.STAGES))
    k = F.col("k")
    severity = F.when(k % 4 < 3, F.element_at(names, (k % 4 + 1).cast("int")))
    title = F.concat(F.lit("이번 달은 "), F.element_at(F.array(*map(F.lit, R.STAGES.values())), (k % 3 + 1).cast("int")))
    return documents(spark, sf).select("item_id", R.stage_label(severity).alias("label"), R.stage_errors(severity, title).alias("errors"))


@query("SELECT conv_id, turn, trim(replace(replace(text, '|', '/'), chr(10), ' ')) AS cell FROM conversations")
def x14_table_cells(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", R.table_cell(F.col("text")).alias("cell"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text, chr(10) || chr(9) || chr(13) || ' ') ELSE 'notes' || chr(10) || text END AS body FROM conversations")
def x13_prompt_bodies(spark, sf):
    head = F.when(F.col("turn") % 2 == 0, "notes\n## System Prompt\n").otherwise("notes\n")
    return table(spark, sf, "conversations").select("conv_id", "turn", R.body(F.concat(head, F.col("text"))).alias("body"))


@query("SELECT item_id, aspect || ' ' || CASE k % 3 WHEN 0 THEN '좋아요' WHEN 1 THEN '별로' ELSE '보통' END AS text, k % 3 = 1 AS tone FROM voc")
def x17_tones(spark, sf):
    k = F.col("k") % 3
    rows = documents(spark, sf).select("item_id", F.concat_ws(" ", "aspect", F.when(k == 0, "좋아요").when(k == 1, "별로").otherwise("보통")).alias("text"))
    return rows.withColumn("tone", text.any_marker(F.col("text"), ("별로", "실망", "최악")))


@query("SELECT item_id, round(k / 7.0, 9) AS exact, round(round(k / 7.0, 4), 1) AS tenth FROM voc")
def x10_allowed_numbers(spark, sf):
    ratio = F.col("k").cast("double") / 700
    allowed = F.transform(V.allowed_percents([ratio]), lambda x: x["value"])
    return documents(spark, sf).select("item_id", F.round(F.col("k") / 7.0, 9).alias("exact"), F.element_at(F.filter(allowed, lambda v: v == F.round(v, 1)), 1).alias("tenth"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN '2024-01-31T23:30:00' WHEN n_nationkey % 3 = 1 THEN '2024-02-01T08:30:00+09:00' ELSE '2024-02-01T06:30:00+09:00' END AS at FROM nation")
def y08_local_or_as_is(spark, sf):
    k = F.col("n_nationkey") % 3
    stamp = F.when(k == 0, "2024-01-31T23:30:00").when(k == 1, "2024-01-31T23:30:00Z").otherwise("2024-01-31T23:30:00+02:00")
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), R.local_or_as_is(stamp).alias("at"))


@query("SELECT item_id, CASE WHEN k > 0 THEN 60.0 / k * (100 - k) ELSE 0.0 END AS eta, CASE WHEN k > 0 THEN 60.0 / k * (100 - k) ELSE 0.0 END > 90 AS late FROM voc")
def y07_deadlines(spark, sf):
    done, total, seconds = F.col("k"), F.lit(100), F.lit(60.0)
    return documents(spark, sf).select("item_id", R.eta(done, total, seconds).alias("eta"), R.late(done, total, seconds, F.lit(90.0)).alias("late"))


@query("SELECT item_id, 60 - date_diff('day', day, DATE '2024-01-30') AS n60, 1 + date_diff('day', DATE '2024-01-01', day) AS n1, isodow(day) >= 6 AS weekend FROM voc")
def y04_day_numbers(spark, sf):
    """Both anchors of numbered days (day 60 is the last, day 1 the first), and weekends (Y05)."""
    day = F.col("day")
    return documents(spark, sf).select("item_id", times.day_number(day, END).cast("long").alias("n60"), times.day_number(day, "2024-01-01", 1).cast("long").alias("n1"), times.weekend(day).alias("weekend"))


@query("SELECT item_id, concat_ws(';', CASE WHEN k % 5 = 0 THEN 'id' END, CASE WHEN k % 7 = 0 THEN 'text' END, CASE WHEN k % 9 = 0 THEN 'repeated' END) AS errors FROM voc")
def z05_input_checks(spark, sf):
    k = F.col("k")
    ids = F.array(F.when(k % 5 == 0, "").otherwise("a"), F.when(k % 9 == 0, F.when(k % 5 == 0, "").otherwise("a")).otherwise("b"))
    content = F.when(k % 7 == 0, None).otherwise("t")
    checks = [("id", F.exists(ids, lambda x: x == "")), ("text", content.isNull()), ("repeated", F.size(F.array_distinct(ids)) < F.size(ids))]
    return documents(spark, sf).select("item_id", F.concat_ws(";", V.errors(checks)).alias("errors"))


@query("SELECT item_id, concat_ws(';', CASE WHEN k % 4 = 0 THEN 'taxonomy' END, CASE WHEN k % 3 = 0 THEN 'evidence' END) AS errors FROM voc")
def z04_contract(spark, sf):
    k = F.col("k")
    label, quote = F.when(k % 4 == 0, "배송").otherwise(F.col("aspect")), F.when(k % 3 == 0, "다른 글").otherwise(F.col("aspect"))
    grounded = F.contains(G.plain(F.concat(F.lit("상품 "), "aspect", F.lit(" 문의"))), G.plain(quote))
    return documents(spark, sf).select("item_id", F.concat_ws(";", V.errors([("taxonomy", ~label.isin(*C.ASPECTS)), ("evidence", ~grounded)])).alias("errors"))


@query("SELECT item_id, CASE WHEN k % 2 = 0 THEN '{\"id\":' || item_id || ',\"hitl_status\":\"승인\",\"hitl_feedback\":\"good\"}' ELSE '{\"id\":' || item_id || ',\"hitl_status\":\"반려\"}' END AS merged FROM voc")
def m20_merged_reviews(spark, sf):
    """The event's status counts, not that of the copy it carries (also Z10)."""
    even = F.col("k") % 2 == 0
    published = F.struct(F.col("item_id").alias("id"), F.lit("대기").alias("hitl_status"), F.lit("old").alias("hitl_feedback"))
    merged = R.merged_review(published, F.when(even, "승인").otherwise("반려"), F.when(even, "good"))
    return documents(spark, sf).select("item_id", F.to_json(merged).alias("merged"))


@query("SELECT item_id, k % 10 = 0 AS aside, concat_ws(',', CASE WHEN k % 4 = 3 THEN 'kind' END, CASE WHEN k % 7 = 0 OR k % 7 = 6 THEN 'rating' END) AS warnings FROM voc")
def m19_feedback(spark, sf):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "POSITIVE").when(k % 4 == 1, "NEGATIVE").when(k % 4 == 3, "OTHER")
    rows = documents(spark, sf).select("item_id", F.when(k % 10 != 0, F.col("item_id")).alias("feedback_id"), F.lit("r").alias("report_id"), kind.alias("kind"), (k % 7).alias("rating"))
    return R.feedback_checks(rows).select("item_id", "aside", "warnings")


@query("SELECT item_id, CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'new' ELSE aspect END AS label, k % 3 = 0 AND k % 4 = 0 AS drifted FROM voc")
def m21_relabelled(spark, sf):
    rows = documents(spark, sf).select("item_id", "k", F.col("aspect").alias("text"), F.col("aspect").alias("label"))
    judged = F.when(F.col("k") % 4 == 0, "other").otherwise(F.col("text"))
    return R.relabelled(rows.drop("k"), rows.where("k % 3 = 0").select("item_id", F.sha2(judged, 256).alias("text_sha"), F.lit("new").alias("new_label")))


@query(f"SELECT item_id, CASE WHEN k % 3 = 0 THEN '{R.NO_DETAIL}' ELSE 'CS ' || (k + 5) || '건 중 ' || k || '건이 ''' || aspect || ''' 관련 언급' END AS summary, CASE WHEN k % 4 = 0 THEN '{R.NO_DETAIL}' ELSE '- ' || aspect END AS quotes FROM voc")
def m17_evidence(spark, sf):
    k = F.col("k")
    texts = F.array(F.lit(" "), F.when(k % 4 == 0, "").otherwise(F.col("aspect")))
    return documents(spark, sf).select("item_id", R.summary_sentence(F.when(k % 3 != 0, F.col("aspect")), k, k + 5).alias("summary"), R.quote_list(texts).alias("quotes"))


@query(""", al AS (SELECT product, aspect, day FROM voc WHERE sentiment = -1), wn AS (SELECT min(item_id) AS case_id, product, aspect, day AS s, day + 4 AS e FROM voc WHERE sentiment = -1 GROUP BY product, aspect, day)
SELECT case_id, count(*) FILTER (day = e) > 0 AS at_end, count(*) FILTER (day BETWEEN s AND e) AS inside, count(*) FILTER (day NOT BETWEEN s AND e) AS outside FROM wn LEFT JOIN al USING (product, aspect) GROUP BY case_id""")
def m10_day_scores(spark, sf):
    docs = documents(spark, sf).where("sentiment = -1")
    windows = docs.groupBy("product", "aspect", F.col("day").alias("start")).agg(F.min("item_id").alias("case_id")).withColumn("end", F.date_add("start", 4))
    return R.day_scores(docs.select("product", "aspect", "day"), windows)


@query("SELECT count(*) FILTER (sentiment = -1 AND k % 3 <> 0) AS tp, count(*) FILTER (sentiment = -1 AND k % 3 = 0) AS fn, CAST(coalesce(sum(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) FILTER (sentiment = -1), 0) AS BIGINT) AS fp, count(*) FILTER (k % 5 = 0) AS several, count(*) AS n, count(*) FILTER (sentiment = -1 AND k % 3 <> 0) / (count(*) FILTER (sentiment = -1 AND k % 3 <> 0) + sum(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END) FILTER (sentiment = -1)) AS accuracy, count(*) FILTER (k % 5 = 0) / count(*) AS several_rate FROM voc")
def e03_negative_scope(spark, sf):
    k = F.col("k")
    main = F.when(k % 3 == 0, F.lit("x")).otherwise(F.col("aspect"))
    predicted = F.when(k % 5 == 0, F.array(main, F.lit("y"))).otherwise(F.array(main))
    return R.negative_scope(documents(spark, sf).select((F.col("sentiment") == -1).alias("gold_negative"), F.col("aspect").alias("gold_aspect"), predicted.alias("predicted")))


@query("""SELECT count(*) FILTER (kind < 5) AS mutated, count(*) FILTER (kind < 5) AS caught, count(*) FILTER (kind >= 5) AS clean, count(*) FILTER (kind >= 5 AND NOT far) AS passed
FROM (SELECT k % 8 AS kind, abs(k % 50 - k % 40) > 0 AND k % 8 = 6 AS far FROM voc)""")
def e14_sensitivity(spark, sf):
    """Each of the five things that a report is checked for, broken alone, and reports in order, some with numbers; a few of these cite another number than they may."""
    k, aspect = F.col("k"), F.array("aspect")
    kind = k % 8
    number = F.struct((k % 50).cast("double").alias("value"), F.lit("%").alias("unit"))
    covered = F.when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array(F.col("aspect"), F.lit("made up"))).otherwise(aspect)
    said = F.when(kind == 3, F.concat(F.lit("부정 비율이 "), (k + 1000).cast("string"), F.lit("%입니다"))).when(kind == 4, "p-value 기준").when(kind == 6, F.concat(F.lit("부정 비율이 "), (k % 40).cast("string"), F.lit("%입니다"))).otherwise("색상 문의가 늘었습니다")
    errors = V.report_errors(kind != 0, aspect, covered, said, F.array(number))
    return R.sensitivity(documents(spark, sf).select((kind < 5).alias("mutated"), errors.alias("errors")))


@query(""", q AS (
  SELECT vec_id, label, 'label' AS mode, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0
  UNION ALL SELECT vec_id, label, 'paraphrase', list_transform(range(1, len(embedding) + 1), lambda i: 0.4 * CAST(embedding[i] AS DOUBLE) + 0.6 * CAST(embedding[i % len(embedding) + 1] AS DOUBLE)) FROM embeddings WHERE vec_id % 50 = 0
), b AS (
  SELECT q.mode, q.vec_id, arg_min(s.vec_id, (round(list_distance(q.v, CAST(s.embedding AS DOUBLE[])), 9), s.vec_id)) AS best FROM q JOIN embeddings s ON s.label = q.label GROUP BY q.mode, q.vec_id
) SELECT mode, count(*) AS n, count(*) FILTER (best = vec_id) AS hits FROM b GROUP BY mode""")
def v02_top_hits(spark, sf):
    """Whether the nearest stored vector of a query's label is the one asked for: by itself, and by a vector that only resembles it."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    x, d = F.transform("embedding", lambda v: v.cast("double")), F.size("embedding")
    like = F.transform(x, lambda v, i: 0.4 * v + 0.6 * F.get(x, (i + 1) % d))
    out = None
    for mode, q in (("label", x), ("paraphrase", like)):
        best = nearest(asked.select((-F.col("vec_id") - 1).alias("query_id"), q.alias("q"), "label"), e, 1)
        rows = best.agg(F.lit(mode).alias("mode"), rows_n(), F.count_if(F.col("vec_id") == -F.col("query_id") - 1).alias("hits"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT product, channel, source, aspect FROM (SELECT DISTINCT product, channel, source FROM voc) CROSS JOIN (SELECT unnest(['색상', '사이즈', '소재', '파손', '오배송', '기타']) AS aspect)")
def j27_observed_grid(spark, sf):
    slots = documents(spark, sf).select("product", "channel", "source").distinct()
    return slots.select("product", "channel", "source", F.explode(F.array(*map(F.lit, C.ASPECTS))).alias("aspect"))


@query("SELECT l_orderkey * 10 + l_linenumber AS alert_id, n_name, c_mktsegment AS segment, p_brand AS grp FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
def j30_reverse_mapping(spark, sf):
    """From a document over variant, product and group to its alert: four joins on keys."""
    rows = table(spark, sf, "lineitem").where("l_quantity > 45").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("alert_id"), "l_orderkey", "l_partkey")
    rows = rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey")
    rows = rows.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    rows = rows.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return rows.select("alert_id", "n_name", F.col("c_mktsegment").alias("segment"), F.col("p_brand").alias("grp"))


@query(GRID + "SELECT product, channel, source, min(cur_total) OVER (PARTITION BY product, channel) >= 10 AS open FROM t")
def w13_small_samples(spark, sf):
    """The first gate looks at a whole product and channel, across sources."""
    return grid_of(spark, sf).select("product", "channel", "source", (~F.coalesce(F.col("hold") == "small_sample", F.lit(False))).alias("open")).distinct()


@query("SELECT item_id, k * 1000000 BETWEEN 1 AND 10485760 AS stored, CAST(day + 30 AS VARCHAR) AS object_end, CAST(least(day + k, day + 30) AS VARCHAR) AS link_end FROM voc")
def k15_limits(spark, sf):
    object_end, link_end = O.expiry(F.col("day"), F.lit(30), F.col("k"))
    return documents(spark, sf).select("item_id", O.within_limit(F.col("k") * 1_000_000).alias("stored"), object_end.cast("string").alias("object_end"), link_end.cast("string").alias("link_end"))


@query("SELECT coalesce(k % 7 <> 3, FALSE) AS taken, count(*) AS n FROM voc GROUP BY ALL")
def k06_sink_split(spark, sf):
    rows = documents(spark, sf).withColumn("amount", F.when(F.col("k") % 7 != 3, F.col("k")))
    taken, aside = O.partitioned_or_aside(rows, F.col("amount") >= 0)
    return taken.agg(rows_n()).select(F.lit(True).alias("taken"), "n").unionByName(aside.agg(rows_n()).select(F.lit(False).alias("taken"), "n"))
