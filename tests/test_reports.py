"""Notices, tables, reasons and published versions on edge cases, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sori.operators import outputs as O
from sori.operators import reports as R


def plain_notice(labels, budget):
    """The rule spelt out: the tail's room first, one label at least, none behind a gap."""
    if not labels or budget <= 0:
        return ""
    if len(", ".join(labels)) <= budget:
        return ", ".join(labels)
    room = budget - len(f" 외 {len(labels)}개")
    if room < 1:
        return f"{len(labels)}개"[:budget]
    first = labels[0]
    if len(first) > room:
        code = first[first.rindex("(") :] if first.endswith(")") and "(" in first else ""
        if room <= 1:
            first = first[:room]
        elif code and room - len(code) - 1 >= 1:
            first = first[: room - len(code) - 1] + "…" + code
        else:
            first = first[: room - 1] + "…"
    shown, used = [first], len(first)
    for x in labels[1:]:
        used += len(x) + 2
        if used > room:
            break
        shown.append(x)
    left = len(labels) - len(shown)
    return ", ".join(shown) + (f" 외 {left}개" if left else "")


def test_notices_stay_within_their_budget(spark):
    r = random.Random(3)
    label = lambda: "".join(r.choice("가나다라abc ") for _ in range(r.randint(0, 14))) + r.choice(["", "", "(P001)", "(P12)", ")", "(x"])
    lists = [[label() for _ in range(r.choice([0, 1, 2, 3, 5, 12]))] for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, labels array<string>")
    for budget in (0, 1, 2, 5, 6, 7, 12, 20, 40):
        got = {x.id: x.n for x in rows.select("id", R.notice(F.col("labels"), budget).alias("n")).collect()}
        assert all(len(x) <= max(budget, 0) for x in got.values())
        assert got == {i: plain_notice(x, budget) for i, x in enumerate(lists)}, budget


def test_numbers_of_tables(spark):
    values = [20.0, 0.0, 100.0, 33.333333333, 5.5, 12.3456789, -3.25, 0.5, 0.0625, 0.001234567, 99.99999, 1 / 3, 1234.5678, 45.5, 7.10, 0.0001]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(R.number_text(F.col("v")).alias("t")).collect()
    assert [x.t for x in got] == [f"{v:g}" for v in values]


def test_false_reasons_look_at_all_significant_channels(spark):
    alerts = [("a", "P", "색상", "cs", "ALL", ["NAVER", "ZIGZAG"], 5), ("b", "P", "색상", "cs", "ALL", ["COUPANG"], 5), ("c", "P", "색상", "cs", "NAVER", [], 30), ("d", "P", "소재", "cs", "NAVER", None, 5), ("e", "P", "색상", "cs", "ALL", ["ZIGZAG", "COUPANG"], 16), ("f", "Q", "색상", "cs", "NAVER", [], 5)]
    df = spark.createDataFrame(alerts, "alert_id string, product string, aspect string, source string, channel string, channels array<string>, day int")
    spans = "product string, aspect string, source string, channel string, start int, end int"
    windows = spark.createDataFrame([("P", "색상", "cs", "NAVER", 10, 12), ("P", "색상", "cs", "ZIGZAG", 8, 20)], spans)
    ignored = spark.createDataFrame([("P", "색상", "cs", "COUPANG", 12, 13)], spans)
    got = {r.alert_id: r.reason for r in R.false_reasons(df, windows, ignored).collect()}
    assert got == {"a": R.EARLY, "b": R.OTHER, "c": R.LATE, "d": R.NO_CASE, "e": R.EXCLUDED, "f": R.NO_CASE}
    order = windows.withColumn("place", F.when(F.col("channel") == "NAVER", 1).otherwise(2))
    assert {r.alert_id: r.reason for r in R.false_reasons(df, order, ignored).collect()} == got


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError, match="published"):
        O.published(spark, path)
    for n in range(1, 5):
        before = O.published(spark, path) if n > 1 else None
        assert O.publish(spark.range(n), path) == n
        assert O.published(spark, path).count() == n and (before is None or before.count() == n - 1)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["_current", "v3", "v4"]


def test_dump(spark, tmp_path):
    rows = [("1", {"company_id": "c1", "channel": "NAVER"}, 'a "b", c\nd'), ("2", {"channel": "X"}, None), ("3", None, "z"), ("4", {"company_id": "c2"}, "")]
    df = spark.createDataFrame(rows, "id string, metadata map<string,string>, document string")
    assert O.dump(df, str(tmp_path / "all"), ["channel"]).count() == 4 and O.dump(df, str(tmp_path / "one"), ["channel"], "c1").count() == 1
    raw = next(p for p in (tmp_path / "one").glob("*.csv") if p.stat().st_size > 3).read_bytes()
    assert raw == b'\xef\xbb\xbfid,company_id,channel,document\n1,c1,NAVER,"a ""b"", c\nd"\n'
