"""Small fixtures for planned cases, texts and dates."""

from datetime import date

from pyspark.sql import functions as F

from sori import constants as C
from sori.functions import text, times
from sori.operators import cases as K


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_heaviest_takes_the_first_of_equal_weights(spark):
    got = one(spark, text.heaviest(F.lit("a:0.5,b:0.5,c")), text.heaviest(F.lit("a:x, b :0.1,c:0.3")), text.heaviest(F.lit("")), text.heaviest(F.lit(None).cast("string")))
    assert got == ("a", "c", None, None)


def test_texts(spark):
    got = one(spark, text.keywords(F.lit("색상 이 달라요 색상")), text.parsed_set(F.lit("a| b,,a")), text.any_marker(F.lit("ab"), ("b",)), text.any_marker(F.lit(None).cast("string"), ("b",)))
    assert got == (["색상", "달라요"], ["a", "b"], True, False)


def test_fingerprints_tell_sets_apart_in_any_order(spark):
    total = lambda rows: spark.createDataFrame(rows, "k int, t string").agg(F.sum(text.fingerprint(F.col("k"), F.col("t")))).first()[0]
    assert total([(1, "a"), (2, "b")]) == total([(2, "b"), (1, "a")]) != total([(1, "b"), (2, "a")])


def test_times(spark):
    day = F.lit("2024-03-31").cast("date")
    late = F.lit("2024-01-31 15:00:00").cast("timestamp_ntz")
    got = one(spark, times.ordinal(day), times.from_ordinal(times.ordinal(day)), times.weekend(day), times.day_number(day, "2024-03-31"), *times.month_bounds(day), times.local_time(late).cast("date"))
    assert got == (date(2024, 3, 31).toordinal(), date(2024, 3, 31), True, 60, date(2024, 3, 1), date(2024, 3, 31), date(2024, 2, 1), date(2024, 2, 1))


def test_windows_that_share_rows_are_one(spark):
    rows = [("P1", "A", "cs", 40, 46, "x", False), ("P1", "A", "cs", 40, 46, "y", True), ("P1", "B", "cs", 2, 70, "x", False)]
    windows = K.case_windows(spark.createDataFrame(rows, "product string, channel string, source string, start_day int, end_day int, aspect string, intended boolean"))
    assert sorted((r["channel"], r["aspects"], r["hot"]) for r in windows.collect()) == [("A", ["x", "y"], True), ("B", ["x"], False)]
    days = K.covered_days(windows).groupBy("channel").agg(F.min("n"), F.max("n"), F.count("*")).collect()
    assert sorted(map(tuple, days)) == [("A", 12, 46, 35), ("B", 1, 60, 60)]
    assert sorted(map(tuple, K.hot_channels(windows).collect())) == [("P1", "A", "cs"), ("P1", "A", "review")]


def test_gold_verdict_needs_every_channel(spark):
    v = lambda *flags: K.gold_verdict(F.array(*(F.lit(x).cast("boolean") for x in flags)))
    assert one(spark, v(True, True, True), v(False, False, False), v(True, False, True), v(True, None, True), v(True, True)) == (C.GLOBAL, C.NORMAL, C.BIASED, None, None)


def test_outcomes_and_reviews(spark):
    rec = F.lit(C.ACTIONS["recommend"])
    n = lambda x: F.lit(x)
    got = one(spark, K.outcome(n("other"), n(1), n(1), n(False)), K.outcome(rec, n(0), n(0), n(False)), K.outcome(rec, n(1), n(0), n(False)), K.outcome(rec, n(1), n(0), n(True)), K.outcome(rec, n(1), n(1), n(False)))
    assert got == ("gate_closed", "no_evidence", "routed_without_evidence", "error", None)
    got = one(spark, K.reviewed_text(n("rejected"), n("a"), n("b")), K.reviewed_text(n(None).cast("string"), n(" "), n("b")), K.citations(F.array(*map(F.lit, ["", "ab", "b", "ab "])), n("a"), 1))
    assert got == (None, "b", ["ab"])


def test_missing_predictions_of_days_without_documents(spark):
    ends = spark.createDataFrame([("P1", "cs", date(2024, 1, 10))], "product string, source string, end date")
    docs = spark.createDataFrame([("P1", "cs", date(2024, 1, 3), False), ("P1", "cs", date(2024, 1, 4), True), ("P1", "review", date(2024, 1, 4), False)], "product string, source string, day date, predicted boolean")
    assert sorted(map(tuple, K.missing_predictions(ends, docs).collect())) == [(1, 0, 1), (2, 1, 2), (3, 1, 2)]


def test_replaced_children_count_an_attribute_once(spark):
    schema = "item_id int, aspect string, sentiment int, pos int"
    old, new = spark.createDataFrame([(1, "x", 0, 0), (2, "x", 0, 0), (3, "x", 0, 0)], schema), spark.createDataFrame([(2, "y", 1, 2), (2, "y", -1, 1)], schema)
    answered = spark.createDataFrame([(2,), (3,)], "item_id int")
    assert sorted(map(tuple, K.replaced_children(old, new, answered).collect())) == [(1, "x", 0, 0), (2, "y", -1, 1)]


def test_false_alerts_without_a_case(spark):
    alerts = spark.createDataFrame([(1, "P1", "x", "cs", "A", False), (2, "P1", "x", "cs", "A", True), (3, "P2", "x", "cs", "A", True)], "alert_id int, product string, aspect string, source string, channel string, oracle boolean")
    planned = spark.createDataFrame([("P2", "x", "review", "A", 3, False, True), ("P2", "y", "cs", "A", 3, False, True)], "product string, aspect string, source string, channel string, overlap int, future boolean, scored boolean")
    assert sorted((r["alert_id"], r["category"]) for r in K.first_per_alert(alerts, planned).collect()) == [(1, "classifier_only"), (2, "unexplained"), (3, "other_source")]
