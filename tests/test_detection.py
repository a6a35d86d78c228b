import datetime as dt

from sori import constants as C
from sori.operators import detection as D
from sori.operators import snapshots as S

END = "2024-01-30"


def docs(spark, plan):
    """plan: (product, channel, source, current negatives, current total, past negatives, past total) of the first attribute."""
    rows = []
    for p, c, s, cn, ct, pn, pt in plan:
        rows += [(p, c, s, dt.date(2024, 1, 28), "색상", -1 if i < cn else 0) for i in range(ct)]
        rows += [(p, c, s, dt.date(2024, 1, 10), "색상", -1 if i < pn else 0) for i in range(pt)]
    return spark.createDataFrame(rows, "product string, channel string, source string, day date, aspect string, sentiment int")


def verdict_of(spark, plan):
    grid = D.held_slots(D.slots(docs(spark, plan), END))
    tests = D.tested(grid)
    rows = D.verdicts(grid, tests)
    return grid, tests, {(r.product, r.aspect, r.source): r.verdict for r in rows.collect()}, D.candidates(rows, tests)


def test_biased_global_tentative_indeterminate(spark):
    up, flat = (26, 100, 10, 400), (3, 100, 12, 400)
    plan = [("B", "COUPANG", "cs", *up), ("B", "NAVER", "cs", *flat), ("B", "ZIGZAG", "cs", *flat)]
    plan += [("G", c, "cs", *up) for c in C.CHANNELS]
    plan += [("T", c, "cs", *up) for c in C.CHANNELS[:2]] + [("T", "ZIGZAG", "cs", 2, 8, 3, 40)]
    plan += [("I", "COUPANG", "cs", *up), ("I", "NAVER", "cs", 2, 8, 3, 40), ("I", "ZIGZAG", "cs", 1, 9, 3, 40)]
    grid, tests, got, cands = verdict_of(spark, plan)
    assert [got[(p, "색상", "cs")] for p in "BGTI"] == [C.BIASED, C.GLOBAL, C.TENTATIVE, C.INDETERMINATE]
    assert {r.channel for r in cands.where("product IN ('G', 'T')").collect()} == {"ALL"}
    assert grid.count() == 12 * 6 and tests.where("hold IS NOT NULL").count() == 0
    alerts = {r["product"]: r for r in D.alerts(cands, END).collect()}
    assert alerts["B"].alert_id == "ALT-20240130-B-COLOR-COUPANG" and alerts["B"].confidence == C.LOW
    assert alerts["G"].action == C.ACTIONS["product"] and alerts["I"].confidence == C.MEDIUM


def test_small_sample_holds_all_sources_of_a_channel(spark):
    grid = D.held_slots(D.slots(docs(spark, [("P", "NAVER", "cs", 5, 50, 5, 100), ("P", "NAVER", "review", 1, 8, 1, 40), ("P", "COUPANG", "cs", 5, 50, 0, 0)]), END))
    holds = {(r.channel, r.source): r.hold for r in grid.collect()}
    assert holds == {("NAVER", "cs"): "small_sample", ("NAVER", "review"): "small_sample", ("COUPANG", "cs"): "no_baseline"}


def test_min_delta_is_inclusive(spark):
    grid = D.held_slots(D.slots(docs(spark, [("P", "NAVER", "cs", 22, 200, 64, 800)]), END))
    assert D.tested(grid).where("aspect = '색상'").first().meaningful


def test_suppression(spark):
    day = lambda d: dt.date(2024, 1, d)
    new = spark.createDataFrame([("P", "색상", "NAVER", day(20), 36 / 200), ("Q", "색상", "ALL", day(20), 0.3), ("R", "색상", "ALL", day(20), 0.3)], "product string, main_aspect string, channel string, window_end date, rate double")
    prior = spark.createDataFrame([("P", "색상", "NAVER", day(14), 26 / 200, False), ("Q", "색상", "ALL", day(13), 0.3, False), ("R", "색상", "ALL", day(14), 0.28, False)], "product string, main_aspect string, channel string, window_end date, rate double, resolved boolean")
    assert {r["product"]: r.decision for r in D.suppress(new, prior).collect()} == {"P": "update", "Q": "publish", "R": "suppress"}


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = S.upsert(old, new, ["id"])
    assert sorted(map(tuple, S.upsert(once, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_streaming_drain_drops_copies(spark, tmp_path):
    from sori.streaming.ingest import drain

    schema, seen = "event_id long, ts timestamp", []
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))], schema).write.parquet(str(tmp_path / "in"))
    drain(spark, str(tmp_path / "in"), schema, str(tmp_path / "cp"), lambda df, n: seen.extend(r.event_id for r in df.collect()))
    assert sorted(seen) == [1, 2]


def test_baseline_fallback(spark):
    rows = [(20, 0, 0, 0, 0.05), (20, 5, 40, 100, 0.05), (20, 5, 60, 100, 0.05), (20, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "cur_total long, past_neg long, past_total long, unfiltered_total long, fallback_rate double")
    assert [(r.past_neg, r.past_total) for r in D.baseline_fallback(df).collect()] == [(4, 80), (2, 40), (5, 60), (0, 0)]


def test_text_checks(spark):
    from pyspark.sql import functions as F

    from sori.functions.text import forbidden, label_parts_found, ungrounded

    row = spark.createDataFrame([("The fdr and P = 0.03", [12.4, 30.0], [12.0, 50.0], "사진_색감_오차", "사진 색감이 다르다")], "t string, n array<double>, a array<double>, l string, r string")
    got = row.select(forbidden(F.col("t")).alias("f"), ungrounded(F.col("n"), F.col("a"), 0.5).alias("u"), label_parts_found(F.col("l"), F.col("r")).alias("p")).first()
    assert got.f == ["FDR", "p-value pattern"] and got.u == [30.0] and got.p
