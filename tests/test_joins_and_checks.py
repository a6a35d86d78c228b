"""Small fixtures for joins, measures, samples, checks, sources and outputs."""

import json
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType

from sori.operators import evaluation as E
from sori.operators import joins as J
from sori.operators import outputs as O
from sori.operators import sampling as S
from sori.operators import validation as V
from sori.operators.replay import replay
from sori.sources import files

D = date.fromisoformat


def test_evidence_keeps_order_once_without_blanks(spark):
    lists = spark.createDataFrame([("a", [3, 1, 3, 9, 2]), ("b", [])], "alert_id string, ids array<long>")
    docs = spark.createDataFrame([(1, "x"), (2, " "), (3, "y"), (4, None)], "item_id long, content string")
    assert [(r.item_id, r.pos) for r in J.evidence(lists, docs).orderBy("pos").collect()] == [(3, 0), (1, 1)]


def test_alert_kinds_at_the_ends_of_windows(spark):
    days = {"before": "2024-01-04", "first": "2024-01-05", "last": "2024-01-09", "echo": "2024-01-15", "late": "2024-01-16"}
    rows = [(k, D(d), "P", "색상", "cs", ["NAVER", "COUPANG"]) for k, d in days.items()] + [("none", D("2024-01-05"), "P", "색상", "cs", [])]
    alerts = spark.createDataFrame(rows, "alert_id string, day date, product string, aspect string, source string, channels array<string>")
    schema = "product string, aspect string, channel string, source string, start date, end date"
    truth = spark.createDataFrame([("P", "색상", "NAVER", "cs", D("2024-01-05"), D("2024-01-09"))], schema)
    kinds = {r.alert_id: r.kind for r in J.alert_kinds(alerts, truth, spark.createDataFrame([], schema)).collect()}
    assert kinds == {"before": "false", "first": "true", "last": "true", "echo": "echo", "late": "false", "none": "false"}
    kinds = {r.alert_id: r.kind for r in J.alert_kinds(alerts, spark.createDataFrame([], schema), truth).collect()}
    assert kinds["echo"] == "ignored" and kinds["before"] == "false"


def test_overlaps_equal_plain_ones(spark):
    cases = [(i, "k", date.fromordinal(738000 + i * 3), date.fromordinal(738000 + i * 3 + i % 9)) for i in range(20)]
    alerts = [(i, "k", date.fromordinal(738000 + i * 2)) for i in range(30)]
    out = J.overlapping(spark.createDataFrame(alerts, "alert_id int, key string, day date"), spark.createDataFrame(cases, "case_id int, key string, start date, end date"), ["key"])
    want = set()
    for a, _, day in alerts:
        for c, _, s, e in cases:
            n = min(day.toordinal(), e.toordinal()) - max(day.toordinal() - 6, s.toordinal()) + 1
            if n > 0:
                want.add((a, c, n))
    rows = [(r.alert_id, r.case_id, r.overlap) for r in out.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_measures_that_cannot_be_taken_are_null(spark):
    rows = spark.createDataFrame([("all", True, True), ("clean", False, False), ("mixed", True, True), ("mixed", False, False)], "g string, gold_negative boolean, pred_negative boolean")
    out = {r.g: r for r in E.negative_table(rows, ["g"], 0.1).collect()}
    assert out["all"].precision is None and out["all"].fpr is None and out["all"].recall == 1
    assert out["clean"].recall is None and out["clean"].operational_precision is None
    assert out["mixed"].operational_precision == 1 and abs(out["mixed"].operational_lower - 0.1 / (0.1 + 0.9 * 3)) < 1e-12


def test_unanswered_items_take_no_part(spark):
    gold = spark.createDataFrame([(1, "a", -1), (2, "a", 0)], "id int, aspect string, sentiment int")
    pred = spark.createDataFrame([(1, "a", -1), (1, "b", 0), (7, "a", 0)], "id int, aspect string, sentiment int")
    r = E.attribute_scores(E.matches(gold, pred, ["id"]), []).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 0, 0.5, 1.0)


def test_apportioned_parts_sum_to_the_total(spark):
    w = spark.createDataFrame([("g", n, x, 10) for n, x in (("a", 1), ("b", 1), ("c", 1))], "g string, name string, w int, total int")
    assert sorted((r.name, r.part) for r in S.apportioned(w, ["g"], "name", "w", "total").collect()) == [("a", 4), ("b", 3), ("c", 3)]


def test_whole_groups_keep_the_first_however_large(spark):
    rows = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 9)], "g string, pos int")
    assert {r.g for r in S.whole_groups(rows, "g", "pos", 3).collect()} == {"x"}
    assert S.whole_groups(rows, "g", "pos", 6).count() == 6


def test_numbers_and_their_grounding(spark):
    df = spark.createDataFrame([("1,234건 중 13.0% (2개), 점수 0.21, 3.5%p",), (None,)], "t string")
    first, second = df.select(V.numbers(F.col("t")).alias("n")).collect()
    assert [(x.value, x.unit) for x in first.n] == [(1234.0, "건"), (13.0, "%"), (0.21, ""), (3.5, "%p")]
    assert second.n is None


def test_answers_that_do_not_parse_are_null(spark):
    df = spark.createDataFrame([("no json",), ("[]",), ('[{"id":1,"aspect":"색상","sentiment":-1}]',)], "t string")
    a, b, c = (r.x for r in df.select(V.parsed_answer(F.col("t")).alias("x")).collect())
    assert a is None and b == [] and c[0].sentiment == -1


def test_files_are_read(spark, tmp_path):
    (tmp_path / "cs.csv").write_text("﻿id,at,content\n1,2024-01-02 03:04:05,a\n2,never,b\n", encoding="utf-8")
    rows = files.event_streams(spark, {"cs": (f"{tmp_path}/cs.csv", "id", "at", "INQ-")}).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == ["INQ-1", "INQ-2"] and rows[1].occurred_at is None and json.loads(rows[0].payload)["content"] == "a"
    (tmp_path / "state.json").write_text('{"id":"a","at":"2024-01-05","attempts":-3}\nbroken\n{"id":"b","at":"2023-01-05","attempts":1}\n{"id":"c","at":"2024-02-01"}\n')
    schema = StructType([StructField("id", StringType()), StructField("at", DateType()), StructField("attempts", IntegerType())])
    assert [(r.id, r.attempts) for r in files.state(spark, f"{tmp_path}/state.json", schema, "at", "2024-01-01").orderBy("id").collect()] == [("a", 0), ("c", 0)]
    (tmp_path / "corpus" / "train").mkdir(parents=True)
    (tmp_path / "corpus" / "train" / "x.json").write_text('[{"text":"a"},{"text":"b"}]')
    assert [(r.uid, r.split, r.text) for r in files.json_corpus(spark, f"{tmp_path}/corpus", "struct<text:string>").orderBy("uid").collect()] == [("x.json#0", "train", "a"), ("x.json#1", "train", "b")]


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("2024-05",), ("2024-13",), (None,)], "p string")
    paths = [r.x for r in df.select(O.storage_path(F.lit("monthly"), F.lit("c"), F.col("p"), F.lit("n.pdf")).alias("x")).collect()]
    assert paths == ["reports/monthly/c/2024/05/n.pdf", None, None]
    O.write_csv(df, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 3


def test_replay_publishes_once_and_then_suppresses(spark, tmp_path):
    rows = [(i, "P", c, "cs", date.fromordinal(738900 + d), "색상", -1 if d >= 30 and c == "NAVER" and i % 2 else 0) for d in range(34) for c in ("NAVER", "COUPANG") for i in range(10)]
    docs = spark.createDataFrame(rows, "item_id int, product string, channel string, source string, day date, aspect string, sentiment int")
    out = replay(docs, str(date.fromordinal(738931)), str(date.fromordinal(738933)), f"{tmp_path}/replay").orderBy("window_end").collect()
    assert [r.decision for r in out][0] == "publish" and all(r.channel == "NAVER" for r in out) and {r.decision for r in out[1:]} <= {"update", "suppress"}
    assert len(out) == 3


def test_keyword_overlap_keeps_every_pair_without_expanding_copies(spark, tmp_path):
    """All pairs that overlap follow from classes and their links; a class of copies costs a row for each copy."""
    from itertools import combinations

    from sori.plans.registry import QUERIES

    names = ["red bolt", "bolt red", "red rod", "old pipe gear", "red red bolt", "blue", "", None, "one two three four red"]
    rows = [(i, names[i % len(names)], None if i % 10 == 9 else f"B{i % 2}") for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["a35_keyword_overlap"](spark, str(tmp_path)).collect()
    of = {r.a: r.b for r in got if r.kind == "member"}
    links = {(r.a, r.b): r.jaccard for r in got if r.kind == "link"}
    assert sorted(of) == [i for i, *_ in rows] and len(got) < 230
    want = {}
    for (i, x, p), (j, y, q) in combinations([r for r in rows if r[1] is not None and r[2]], 2):
        x, y = set(x.split(" ")), set(y.split(" "))
        if p == q and len(x & y) / len(x | y) > 0.3:
            want[i, j] = round(len(x & y) / len(x | y), 9)
    pairs = ((i, j, *sorted((of[i], of[j]))) for i, j in combinations(sorted(of), 2))
    assert {(i, j): 1.0 if x == y else links[x, y] for i, j, x, y in pairs if x == y or (x, y) in links} == want


def test_keyword_overlap_lists_every_pair_of_copies(spark, tmp_path, monkeypatch):
    """Every pair of parts is a row, also of parts with equal sets, whichever blocks their keys lie in."""
    from itertools import combinations

    from sori.plans import inputs
    from sori.plans.registry import QUERIES

    monkeypatch.setattr(inputs, "BLOCK", 5)
    names = ["red bolt", "bolt red", "red rod", "old pipe gear", "red red bolt", "blue", "", None, "one two three four red"]
    rows = [(i * 7 % 200, names[i % len(names)], None if i % 10 == 9 else f"B{i % 2}") for i in range(200)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    want = []
    for (i, x, p), (j, y, q) in combinations(sorted((r for r in rows if r[1] is not None and r[2]), key=lambda r: r[0]), 2):
        x, y = set(x.split(" ")), set(y.split(" "))
        if p == q and len(x & y) / len(x | y) > 0.3:
            want.append((i, j, round(len(x & y) / len(x | y), 9)))
    assert sorted(map(tuple, QUERIES["a35_keyword_overlap"](spark, str(tmp_path)).collect())) == want
