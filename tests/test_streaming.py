"""Streams and logs of batches: late files, copies, repeated batches, folds, what a batch writes."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sori.streaming import worker as W
from sori.streaming.ingest import drain

RESULTS = f"item_id long, occurred_at timestamp_ntz, labels {W.LABELS}, error string, call_failed boolean"
EVENTS = "event_id long, ts timestamp_ntz"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(day - 1)


def prepared(e):
    return e.select(F.col("event_id").alias("item_id"), F.col("ts").alias("occurred_at"))


def classify(docs):
    """Every fifth document fails."""
    bad = F.col("item_id") % 5 == 4
    labels = F.when(~bad, F.array(F.struct(F.lit("색상").alias("aspect"), F.lit(-1).alias("sentiment"))))
    return docs.withColumns({"labels": labels, "error": F.when(bad, "parse"), "call_failed": F.lit(False)})


def contents(state):
    return tuple(sorted(map(tuple, getattr(state, t).collect())) for t in ("items", "labels", "failures", "cursor"))


def schema_of(spark):
    return spark.createDataFrame([], EVENTS).schema


def put(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def size(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*.parquet"))


def test_late_files_change_nothing(spark, tmp_path):
    """Files of days 20, 21, 2 (18 days late), 22, with copies and without time, one a batch: the state of one batch over all."""
    days = {20: range(0, 5), 21: range(5, 10), 2: range(10, 15), 22: range(15, 20)}
    files = [[(i, at(d, i % 20)) for i in ids] for d, ids in days.items()] + [[(3, at(20, 3)), (30, None), (30, None), (31, at(1))]]
    for f in files:
        put(spark, str(tmp_path / "in"), f)
        W.follow(spark, str(tmp_path / "in"), schema_of(spark), str(tmp_path / "state"), prepared, classify, "v1", files_per_batch=1, fold_every=2)
    state = W.current(spark, str(tmp_path / "state"))
    everything = spark.createDataFrame(list({x for f in files for x in f}), EVENTS)
    assert contents(state) == contents(W.applied(W.State.empty(spark), classify(prepared(everything)), "v1"))
    assert state.items.count() + state.failures.count() == 22 and [(r.occurred_at, r.item_id) for r in state.cursor.collect()] == [(at(22, 19), 19)]
    assert sorted(map(tuple, W.arrivals(spark, str(tmp_path / "state")).collect())) == [(4, 2, 1)]  # since the last fold; one of two is dated and late


def test_files_at_once_and_one_by_one_are_the_same(spark, tmp_path):
    rows = [[(10 * k + i, at(1 + (7 * k + i) % 25, i)) for i in range(8)] for k in range(4)]
    for f in rows:
        put(spark, str(tmp_path / "in"), f)
    for n in (1, 4):
        W.follow(spark, str(tmp_path / "in"), schema_of(spark), str(tmp_path / f"s{n}"), prepared, classify, "v1", files_per_batch=n)
    assert contents(W.current(spark, str(tmp_path / "s1"))) == contents(W.current(spark, str(tmp_path / "s4")))


def test_drain_keeps_late_rows(spark, tmp_path):
    seen = []
    for f in ([(1, at(20)), (1, at(20))], [(2, at(1)), (1, at(20))], [(2, at(1)), (3, None)], [(3, None), (4, at(9))]):
        put(spark, str(tmp_path / "in"), f)
        drain(spark, str(tmp_path / "in"), schema_of(spark), str(tmp_path / "cp"), lambda df, n: seen.extend(r.event_id for r in df.collect()))
    assert seen == [1, 2, 3, 4]


def batch(spark, ids, day=1, bad=()):
    return spark.createDataFrame([(i, at(day), None if i in bad else [("색상", -1)], "parse" if i in bad else None, False) for i in ids], RESULTS)


def test_a_commit_writes_its_batch_only(spark, tmp_path):
    """The same small batch after a small state and after a large one, with the failure of a document that it clears."""
    written = []
    for n in (20, 20_000):
        path = str(tmp_path / f"s{n}")
        W.commit(W.applied(W.State.empty(spark), batch(spark, range(n), bad=(3, 7)), "v1"), path, 0)
        W.commit(W.applied(W.current(spark, path), batch(spark, [3, 7, n + 1], day=2, bad=(7,)), "v2"), path, 1)
        written.append(size(f"{path}/changes/1"))
        state = W.current(spark, path)
        assert state.items.count() == n and {r.item_id: r.attempts for r in state.failures.collect()} == {7: 2}
        assert {r.item_id for r in state.items.where("version = 'v2'").collect()} == {3, n + 1} and state.labels.count() == n
    assert written[1] < 1.1 * written[0] and size(tmp_path / "s20000/changes/0") > 3 * written[1]


def test_batches_count_whole_and_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "s")
    W.commit(W.applied(W.State.empty(spark), batch(spark, [1, 2], bad=(2,)), "v1"), path, 0)
    first = contents(W.current(spark, path))
    after = W.applied(W.current(spark, path), batch(spark, [2, 3], day=5), "v1")
    W.commit(after, path, 1)
    whole = contents(W.current(spark, path))
    for part in (tmp_path / "s/changes/1/cursor").iterdir():  # as if the writer was lost before the last table
        part.unlink()
    assert contents(W.current(spark, path)) == first
    W.commit(W.applied(W.current(spark, path, 1), batch(spark, [2, 3], day=5), "v1"), path, 1)
    W.commit(W.applied(W.current(spark, path, 1), batch(spark, [2, 3], day=5), "v1"), path, 1)
    assert contents(W.current(spark, path)) == whole and contents(W.current(spark, path, 1)) == first
    with pytest.raises(ValueError, match="applied"):
        W.commit(W.current(spark, path), path, 2)


def test_the_cursor_never_moves_back(spark, tmp_path):
    path = str(tmp_path / "s")
    for n, day in enumerate((9, 4, 12, 1)):
        W.commit(W.applied(W.current(spark, path), batch(spark, [n], day=day), "v1"), path, n)
        assert W.current(spark, path).cursor.first().occurred_at == at(max((9, 4, 12, 1)[: n + 1]))
    assert sorted(map(tuple, W.arrivals(spark, path).collect())) == [(0, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 1)]


def test_folds_change_nothing_and_drop_old_entries(spark, tmp_path):
    path, plain = str(tmp_path / "s"), W.State.empty(spark)
    for n in range(6):
        results = batch(spark, range(2 * n, 2 * n + 4), day=n + 1, bad=(2 * n + 1,) if n % 2 else ())
        plain = W.applied(plain, results, f"v{n}")
        plain = W.State(*(spark.createDataFrame(t.collect(), t.schema) for t in (plain.items, plain.labels, plain.failures, plain.cursor)))
        W.commit(W.applied(W.current(spark, path), results, f"v{n}"), path, n)
        before = contents(W.current(spark, path))
        if n in (1, 3, 4):
            W.fold(spark, path, n)
            W.fold(spark, path, n)
        assert contents(W.current(spark, path)) == before == contents(plain)
    assert sorted(p.name for p in (tmp_path / "s/folded").iterdir()) == ["3", "4"] and sorted(p.name for p in (tmp_path / "s/changes").iterdir()) == ["4", "5"]


def decided_day_by_day(spark, alerts, resolved):
    """What the batch rule decides, one day after another, with what was published so far."""
    from sori.operators import detection as D

    prior, out = [], {}
    for day in sorted({a[4] for a in alerts}):
        new = spark.createDataFrame([a for a in alerts if a[4] == day], "alert_id string, product string, main_aspect string, channel string, window_end date, rate double")
        rows = [(a[1], a[2], a[3], a[4], a[5], a[0] in resolved) for a in prior]
        got = D.suppress(new, spark.createDataFrame(rows, "product string, main_aspect string, channel string, window_end date, rate double, resolved boolean")).collect()
        out |= {r.alert_id: r.decision for r in got}
        prior += [a for a in alerts if out.get(a[0]) in ("publish", "update") and a not in prior]
    return out


def test_suppression_stream_equals_the_rule_day_by_day(spark, tmp_path):
    import random

    from sori.streaming.suppression import suppressed

    r, alerts = random.Random(5), []
    for d in range(1, 26, 2):
        for p in ("P1", "P2"):
            if r.random() < 0.8:
                alerts.append((f"{p}-{d}", p, "색상", "ALL", (at(1) + dt.timedelta(d)).date(), round(r.choice([0.1, 0.12, 0.16, 0.3]), 2)))
    done = {a[0] for a in alerts if r.random() < 0.3}
    rows = [(*a, False) for a in alerts] + [(*a, True) for a in alerts if a[0] in done]
    schema = "alert_id string, product string, main_aspect string, channel string, window_end date, rate double, resolved boolean"
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for low, high in ((0, 9), (9, 99)):  # the state goes on from one run to the next
            part = [x for x in rows if low <= (x[4] - at(1).date()).days < high]
            spark.createDataFrame(r.sample(part, len(part)), schema).write.mode("append").parquet(str(tmp_path / "in"))
            stream = suppressed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = decided_day_by_day(spark, alerts, done)
    assert {x.alert_id: x.decision for x in got} == want and len(got) == len(alerts) and len(set(want.values())) == 3
    ids = {a[0] for a in alerts}
    assert all((x.updates_alert_id in ids - done) == (x.decision == "update") for x in got)


def test_bad_rows_stand_alone(spark, tmp_path):
    """Rows of 64 that a table refuses, two of one key, some by the one table, some by the other; null keys; a table without rows."""
    from sori.streaming import sinks

    rows = [(str(i), "x" if i in (5, 40) else str(i), None if i in (7, 40) else "p") for i in range(64)] + [("5", "y", "p"), (None, "1", "p")]
    df = spark.createDataFrame(rows, "id string, amount string, name string")
    number = F.expr("CAST(amount AS INT) AS amount")
    tables = {"a": sinks.Table(F.lit(True), ("id", number)), "b": sinks.Table(F.col("amount") != "9", ("id", sinks.required(F.col("name"), "name").alias("name"))), "c": sinks.Table(F.lit(False), ("id",))}
    path = str(tmp_path / "s")
    for _ in range(2):
        sinks.write_batch(df, 0, path, tables, "id")
    a, b = (sinks.read_table(spark, path, t, s).collect() for t, s in (("a", "id string, amount int"), ("b", "id string, name string")))
    assert sorted((r.id for r in a), key=str) == sorted((i for i, *_ in rows if i not in ("5", "40")), key=str)
    assert sorted((r.id for r in b), key=str) == sorted((i for i, x, _ in rows if i not in ("7", "40") and x != "9"), key=str)
    aside = {(r.table_name, r.key): r.reason for r in sinks.read_table(spark, path, "aside", sinks.ASIDE).collect()}
    assert set(aside) == {("a", "5"), ("a", "40"), ("b", "7"), ("b", "40")} and "name is missing" in aside["b", "7"] and "CAST_INVALID_INPUT" in aside["a", "5"]
    assert sinks.read_table(spark, path, "c", "id string").count() == 0
    sinks.delete(spark, f"{path}/0/aside")  # as if the writer was lost before the end
    assert sinks.read_table(spark, path, "a", "id string, amount int").count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sinks.write_batch(df, 1, path, tables, "id", most=1)


def test_foreseen_refusals_go_aside_in_one_pass(spark, tmp_path):
    """Many refused rows cost no writes of parts and count to no limit; what is not foreseen still stands alone."""
    from sori.streaming import sinks

    rows = [(i, "x" if i % 3 == 0 else "?" if i == 7 else None if i == 8 else str(i), None if i % 6 == 0 else "p", "own") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, amount string, name string, reason string")
    number = F.expr("CAST(amount AS INT) AS amount")
    refused = {"nameless": F.col("name").isNull(), "letters": F.col("amount") == "x"}
    path = str(tmp_path / "s")
    sinks.write_batch(df, 0, path, {"a": sinks.Table(F.lit(True), ("id", number, "reason"), refused), "b": sinks.Table(F.col("id") > 99, ("id",), refused)}, "id", most=1)
    got = sinks.read_table(spark, path, "a", "id long, amount int, reason string").collect()
    assert sorted(r.id for r in got) == [i for i in range(60) if i % 3 and i != 7] and {r.reason for r in got} == {"own"}
    assert len(list((tmp_path / "s/0/a").iterdir())) < 20  # parts for the one row that was not foreseen
    aside = {int(r.key): r.reason for r in sinks.read_table(spark, path, "aside", sinks.ASIDE).collect()}
    assert aside.pop(7).startswith("[CAST_INVALID_INPUT]")
    assert aside == {i: "nameless" if i % 6 == 0 else "letters" for i in range(0, 60, 3)}


def test_sliding_windows_take_late_days(spark, tmp_path):
    """Days in no order, one of them 30 days late; a repeated run adds nothing."""
    from sori.streaming.windows import keep_updates, newest_counts, sliding_counts

    days, seen = [(40, 3), (41, 1), (10, 2), (36, 5), (12, 4)], []
    for day, n in days:
        spark.createDataFrame([("P", at(day).date())] * n, "product string, day date").write.mode("append").parquet(str(tmp_path / "in"))
        seen.append((day, n))
        for _ in range(2):
            stream = spark.readStream.schema("product string, day date").parquet(str(tmp_path / "in"))
            keep_updates(sliding_counts(stream, ["product"]), str(tmp_path / "out"), str(tmp_path / "cp"))
        got = {r.window_end: (r.current, r.past) for r in newest_counts(spark, str(tmp_path / "out"), ["product"]).collect()}
        for end in (12, 16, 40, 41, 44, 50, 75):
            age = [(end - d, n) for d, n in seen]
            want = sum(n for a, n in age if 0 <= a < 7), sum(n for a, n in age if 7 <= a < 35)
            assert got.get(at(end).date(), (0, 0)) == want
