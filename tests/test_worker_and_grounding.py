"""Labelling batches, grounding of quotes, outputs: against plain versions and on edge cases."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sori.operators import grounding as G
from sori.operators import outputs as O
from sori.operators import reports as R
from sori.streaming import worker as W

RESULTS = f"item_id long, occurred_at timestamp_ntz, labels {W.LABELS}, error string, call_failed boolean"


def test_grounding_equals_the_library(spark):
    r = random.Random(1)
    words = "배송 색상 사이즈 느려요 달라요 작아요 the red ring".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 5))), " ".join(r.choice(words) for _ in range(r.choice([5, 80])))) for i in range(120)]
    rows += [(200, "", "x"), (201, None, "x"), (202, "?!", "?!"), (203, "abc", None), (204, "ABC d", "xabcdx")]
    got = {x.id: x.grounded for x in G.with_evidence(spark.createDataFrame(rows, "id int, quote string, source string")).collect()}

    def want(q, s):
        q, s = ("".join(c for c in (t or "").lower() if c.isalnum() or c == "_") for t in (q, s))
        if not q or not s:
            return False
        return q in s or SequenceMatcher(None, q, s).find_longest_match(0, len(q), 0, len(s)).size / len(q) >= 0.8

    assert got == {i: want(q, s) for i, q, s in rows} and len(set(got.values())) == 2


def test_leaks_equal_the_library(spark):
    examples = ["the ring is too small", "wrong colour came"]
    texts = ["the ring is too small", "the ring is too big", "nothing alike at all", "", None, "the ring is too small"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {x.id: (x.similarity, x.leaked) for x in G.without_leaks(rows, examples, 0.8).collect()}
    best = lambda t: round(max(SequenceMatcher(None, t, e).ratio() for e in examples), 4)
    assert got == {i: (0.0, False) if t is None else (best(t), best(t) >= 0.8) for i, t in enumerate(texts)}


def test_halts_only_on_failed_calls(spark):
    rows = [(i, None, None, "parse", False) for i in range(3)]
    assert not W.halts(spark.createDataFrame(rows, RESULTS).withColumn("b", F.lit(0)), ["b"]).first().halt
    assert W.halts(spark.createDataFrame([*rows, (9, None, None, "timeout", True)], RESULTS).withColumn("b", F.lit(0)), ["b"]).first().halt
    assert not W.halts(spark.createDataFrame([*rows, (9, None, [], None, True)], RESULTS).withColumn("b", F.lit(0)), ["b"]).first().halt


def test_batches_replace_themselves_and_empty_ones_change_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    first = spark.createDataFrame([(1, None, [("색상", -1)], None, False), (2, None, None, "parse", False)], RESULTS).withColumn("occurred_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    for _ in range(2):
        state = W.commit(W.applied(W.current(spark, path, 0), first, "v1"), path, 0)
    assert [r.attempts for r in state.failures.collect()] == [1] and state.labels.count() == 1
    again = W.applied(state, first.where("item_id = 2"), "v1", advance=False)
    assert [r.attempts for r in again.failures.collect()] == [2] and again.cursor.collect() == state.cursor.collect()
    nothing = W.applied(state, first.where("false"), "v1")
    assert nothing.items.count() == 1 and nothing.cursor.collect() == state.cursor.collect()


def test_halted_stream_raises(spark, tmp_path):
    spark.range(3).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    broken = lambda docs: docs.select(F.col("event_id").alias("item_id"), F.col("ts").cast("timestamp_ntz").alias("occurred_at"), F.lit(None).cast(W.LABELS).alias("labels"), F.lit("timeout").alias("error"), F.lit(True).alias("call_failed"))
    with pytest.raises(Exception, match="every document failed"):
        W.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), lambda b: b, broken, "v1")
    assert W.current(spark, str(tmp_path / "out")).items.count() == 0


def test_csv_has_a_mark_and_swap_replaces(spark, tmp_path):
    df = spark.createDataFrame([(1, "가")], "id int, name string").coalesce(1)
    O.write_csv(df, str(tmp_path / "c"))
    raw = next((tmp_path / "c").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,")
    for n in (1, 2):
        O.swap(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and not (tmp_path / "t.old").exists()


def test_notice_and_stage(spark):
    row = spark.range(1).select(R.notice(F.array(F.lit("ab"), F.lit("cd"), F.lit("efghij")), 6).alias("n"), R.notice(F.array().cast("array<string>"), 6).alias("e"), R.stage_errors(F.lit(None).cast("string"), F.lit("x")).alias("s")).first()
    assert (row.n, row.e, row.s) == ("a 외 2개", "", "")


def test_longest_pieces_equal_the_library(monkeypatch):
    """Frequent characters of long sources, ties, pairs without a common character, empty texts, several portions."""
    from sori.functions import matching

    monkeypatch.setattr(matching, "PORTION", 5000)
    r, quotes, sources = random.Random(1), ["", "", "a", "\ud800b"], ["", "x", "", "b\ud800"]
    for _ in range(800):
        letters = r.choice(["ab", "abc", "abcdefgh", "가나다라마바사아자차"])
        quotes.append("".join(r.choice(letters) for _ in range(r.randint(0, 30))))
        sources.append("".join(r.choice(letters + r.choice(["", "xyz" * 5])) for _ in range(r.choice([0, 3, 20, 60, 199, 200, 250, 400]))))
    got = matching.longest_pieces(quotes, sources).tolist()
    assert got == [SequenceMatcher(None, q, s).find_longest_match(0, len(q), 0, len(s)).size for q, s in zip(quotes, sources)]
    assert matching.longest_pieces([], []).tolist() == []


def test_exact_permutations(spark):
    """Against all tables one by one, the case of two categories, draws, and empty sides."""
    from itertools import product
    from math import comb, log2

    from sori.operators import monthly as M

    rows = [("a", "x", "y", [3, 0, 2, 1, 0, 1], [1, 2, 0, 4, 0, 0]), ("b", "x", "y", [1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]), ("c", "x", "y", [0] * 6, [1, 1, 0, 0, 0, 0]), ("d", "x", "y", [40, 2, 0, 0, 0, 0], [30, 15, 0, 0, 0, 0])]
    pairs = spark.createDataFrame(rows, "product string, channel_a string, channel_b string, x array<long>, y array<long>")
    got = {r["product"]: r for r in M.tested_pairs(pairs).collect()}
    drawn = {r["product"]: r for r in M.tested_pairs(pairs, most=0).collect()}

    def bits(x, y):
        n, o = sum(x), sum(y)
        return sum((v / n * log2(2 * v / n / (v / n + w / o)) if v else 0) + (w / o * log2(2 * w / o / (v / n + w / o)) if w else 0) for v, w in zip(x, y)) / 2

    for name, _, _, x, y in rows[:2]:
        m = [a + b for a, b in zip(x, y)]
        weigh = lambda z: 1.0 if not z else comb(m[len(z) - 1], z[-1]) * weigh(z[:-1])  # noqa: B023, E731
        tables = [(z, weigh(z)) for z in product(*(range(k + 1) for k in m)) if sum(z) == sum(x)]
        every = sum(w for _, w in tables)
        null = [(bits(z, [a - b for a, b in zip(m, z)]), w / every) for z, w in tables]
        assert got[name].jsd == pytest.approx(bits(x, y)) and got[name].baseline == pytest.approx(sum(d * w for d, w in null), abs=1e-8)
        assert got[name].p_value == pytest.approx(sum(w for d, w in null if d >= bits(x, y) - 1e-10), abs=1e-8)
    assert tuple(got["c"])[3:] == (0.0, 0.0, 1.0)
    two = spark.range(1).select(*M.exact_test(F.lit(40), F.lit(30), F.lit(42), F.lit(45))).first()
    assert (got["d"].baseline, got["d"].p_value) == pytest.approx(tuple(two), abs=1e-8)
    assert all(drawn[k].p_value == pytest.approx(got[k].p_value, abs=0.02) for k in "abd") and len(drawn) == 4


def test_matching_blocks_equal_the_library():
    from sori.functions import matching

    r, a, b = random.Random(2), ["", "x", ""], ["", "", "y"]
    for _ in range(500):
        letters = r.choice(["ab", "abc", "abcdefgh ", "가나다라마바사아자차"])
        x = "".join(r.choice(letters) for _ in range(r.choice([1, 5, 30, 120, 210])))
        y = "".join(c if r.random() < 0.8 else r.choice(letters + "zz") for c in x) if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(r.choice([3, 40, 205])))
        a.append(x)
        b.append(y)
    assert matching.matched_characters(a, b).tolist() == [sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(a, b)]


@pytest.mark.parametrize("threshold", [0.8, 0.5, 1.0])
def test_leaks_of_many_examples(spark, threshold):
    """Against all pairs: texts that are edited examples, near ones at the bounds of length, ties, empty and null ones."""
    r = random.Random(6)
    prose = lambda n: "".join(r.choice("abcdefghij klmno") for _ in range(n))
    examples = [(i, prose(r.choice([1, 4, 20, 60, 130]))) for i in range(60)] + [(60, ""), (61, None)]
    examples += [(100, examples[5][1])]
    texts = []
    for i, e in examples[:60]:
        texts += [e, e + prose(r.randint(0, len(e))), "".join(c if r.random() < 0.9 else "x" for c in e), e[len(e) // 3 :]]
    texts += ["", None, "zzz"]
    got = {x.text: (x.example_id, x.similarity) for x in G.leaked_from(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(examples, "example_id long, text string"), threshold).collect()}
    want = {}
    for t in {t for t in texts if t}:
        best = min((-SequenceMatcher(None, t, e).ratio(), i) for i, e in examples if e)
        if -best[0] >= threshold:
            want[t] = (best[1], round(-best[0], 4))
    assert got == want and len(want) > 50
