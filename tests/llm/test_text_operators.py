"""Fill-in-middle, periodic runs and repeated passages against plain versions, and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sori.llm import fim, periodic, queries, substring, suffixes

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASH = "id long, key string, block int, n string, runs int, units int, words string, form int, g long, a int, p int, row long, first int, prefix int, digest int, best int, size string"


def frame(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    return df.select("*", *(F.lit(7).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ") if c.split()[0] not in df.columns))


def run_query(spark, path, query, rows):
    frame(spark, rows).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return query(spark, str(path))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


TEXTS = [
    (1, "one\ntwo\nthree\n"), (2, "one\ntwo"), (3, "\n\n\n"), (4, None), (5, ""), (6, "no end"), (7, "has <S> in it\nand more"), (8, "a<\nP>b<\nS>\n<\nM>"), (9, "naïve 東京 😀\r\nline  two\n\nthird 😀😀"), (None, "x\ny\nz"), (10, "x" * 200_000 + "\n" + "y\n" * 5000),
    (12, "same\nrow\n"), (12, "same\nrow\n"), (-13, "<P\n>S\n<M\n"),
] + [(100 + i, "".join(f"{i} line {k}\n" for k in range(i % 7))) for i in range(40)]


def expected_fim(doc, text, spm=50, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc, len(units), form, len(pre), len(mid), sha(f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"), sha(text)


def test_fill_in_middle(spark, tmp_path):
    out = run_query(spark, tmp_path, queries.op11_fim, TEXTS)
    assert Counter(map(tuple, out.collect())) == Counter(expected_fim(*x) for x in TEXTS)
    assert {r.form for r in out.collect()} == {"plain", "psm", "spm"}
    assert "Python" not in out._jdf.queryExecution().toString() and "Exchange" not in out._jdf.queryExecution().toString()
    assert queries.op11_fim(spark, str(tmp_path)).columns == run_query(spark, tmp_path / "none", queries.op11_fim, []).columns and queries.op11_fim(spark, str(tmp_path / "none")).count() == 0


def test_fill_in_middle_rates_and_sentinels(spark):
    marks = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    rows = fim.rearranged(frame(spark, TEXTS), rate=40, spm=0, sentinels=marks)
    got = rows.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.back == r.text for r in got) and {r.form for r in got} == {"plain", "psm"}
    assert {r.doc_id: r.form for r in got if r.doc_id and r.doc_id > 100} == {d: expected_fim(d, t, 0, 40)[2] for d, t in TEXTS if d and d > 100}


def brute_runs(words, min_length=6, min_exponent=4):
    out = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(min_length, min_exponent * q) and not any(d < q and q % d == 0 for d in out.get((s, n), [])):
                out.setdefault((s, n), []).append(q)
            i += 1
    return sorted((s, n, min(qs)) for (s, n), qs in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(0, 40), st.integers(1, 9), st.sampled_from([(6, 4), (1, 3), (1, 5)]))
def test_runs_equal_brute_force(x, a, p, least):
    x = x[:a] + [x[a + (i - a) % p] for i in range(a, len(x)) if a + p <= len(x)]
    got = suffixes.runs(np.array([*x, 99]), *least)
    assert sorted(zip(*(v.tolist() for v in got))) == brute_runs(x, *least)


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(40)), st.integers(0, 8))
def test_next_smaller(values, rounds):
    got = suffixes.next_smaller(np.array(values), rounds).tolist()
    assert got == [next((j for j in range(i + 1, 40) if values[j] < values[i]), 40) for i in range(40)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_suffixes_and_common_prefixes(x):
    x = [*x, 99]
    order, levels = suffixes.sorted_suffixes(np.array(x))
    assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    want = [next(k for k in range(len(x)) if x[a + k] != x[b + k]) for a, b in zip(order, order[1:])]
    prefixes = suffixes.common_prefixes(order, levels)
    assert prefixes.tolist() == [0, *want]
    table = suffixes.minima(prefixes)
    low, high = (np.array(v) for v in zip(*[(i, j) for i in range(len(x)) for j in range(i, len(x))]))
    assert suffixes.range_minimum(table, low, high).tolist() == [min(prefixes[i : j + 1]) for i, j in zip(low, high)]


def expected_runs(doc, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode())
    if plant and doc is not None and h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = None
    for x in found:
        if best is None or x[1] * best[2] > best[1] * x[2]:
            best = x
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))


def test_periodic_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "PORTION", 3000)
    r = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "a " * 50), (None, "b " * 9 + prose(1, 20)), (5, "x y " * 30 + "x"), (5, "x y " * 30 + "x"), (6, "no break space " * 5), (7, prose(2, 400)), (8, "w " * 4000), (9, "é É é É é É é É")]
    rows += [(i, " ".join(prose(i, r.randint(1, 30)) + " " + (prose(i + 1, r.randint(1, 5)) + " ") * r.choice([1, 2, 4, 7]) for _ in range(3))) for i in range(20, 220)]
    want = Counter(expected_runs(*x) for x in rows)
    assert Counter(map(tuple, run_query(spark, tmp_path, queries.op13_runs, rows).collect())) == want
    assert sum(d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 9 and sum(x[1] > 1 for x in want) > 9
    assert run_query(spark, tmp_path / "none", queries.op13_runs, []).count() == 0
    texts = {x.doc_id: x for x in periodic.periodic_runs(frame(spark, rows)).collect()}
    assert texts[4].text == "a" and texts[4].n_words == 50 and [tuple(x) for x in texts[5].runs] == [(0, 61, 2)] and texts[1].text == "" and texts[1].runs == []
    with pytest.raises(ValueError, match="at least 3"):
        periodic.periodic_runs(frame(spark, rows), min_exponent=2)


def expected_repeats(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return Counter(out)


def repeated_corpus():
    """Exact and near copies, passages shared by many, by two and within a text, one word again and again."""
    r = random.Random(9)
    passages = [prose(700 + i, r.randint(34, 80)) for i in range(12)]
    rows = [(i, " ".join([prose(i, r.randint(0, 60)), *((r.choice(passages), prose(i + 5000, r.randint(0, 50))) * r.randint(0, 2)), "\n\t end"])) for i in range(80)]
    copy = prose(42, 300)
    rows += [(200 + i, copy) for i in range(9)]
    for i in range(25):
        words = copy.split()
        for _ in range(3):
            words[r.randrange(300)] = "edited"
        rows.append((300 + i, " ".join(words)))
    rows += [(400, "a " * 120), (401, "a " * 36 + "b " + "a " * 35), (402, prose(77, 40) + " x " + prose(77, 40)), (403, prose(78, 34) + " y " + prose(78, 34)), (404, None), (405, ""), (406, " \n "), (None, passages[0]), (407, prose(79, 9000)), (407, prose(79, 9000)), (408, "Ünï cödé " * 30)]
    return rows


@pytest.mark.parametrize("group", [256, 3, 1])  # with 3 and 1, larger groups are split by longer prefixes
def test_repeated_passages(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "PORTION", 20_000)
    rows = repeated_corpus()
    want = expected_repeats(rows, 35)
    assert Counter(map(tuple, run_query(spark, tmp_path, queries.op12_substring, rows).collect())) == want
    assert sum(x[2] > 0 for x in want) > 40 and sum(x[2] == 0 for x in want) > 10
    if group == 3:
        assert run_query(spark, tmp_path / "none", queries.op12_substring, []).count() == 0


@pytest.mark.parametrize("window", [2, 5, 9, 64, 70])
def test_repeats_of_other_sizes(spark, window):
    rows = [(d, t) for d, t in repeated_corpus() if d != 407]
    out = substring.drop_repeats(frame(spark, rows), window).collect()
    assert Counter((x.doc_id, x.n_words, x.n_removed, sha(x.text)) for x in out) == expected_repeats(rows, window)
    assert all(sum(e - s for s, e in x.spans) == x.n_removed and all(a[1] < b[0] for a, b in zip(x.spans, x.spans[1:])) for x in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=1, max_size=60), st.integers(1, 9))
def test_deep_leaves(x, depth):
    at = [i for i in range(len(x) - depth + 1) if sum(x[i : i + depth] == x[j : j + depth] for j in range(len(x) - depth + 1)) > 1]
    assert substring.deep_leaves(np.array([*x, 99]), depth).tolist() == at


def test_rolling_hashes_and_first_smallest():
    r = np.random.default_rng(2)
    v = r.integers(0, 2**63, 50).astype(np.uint64)
    v[30:40] = v[5:15]
    h = substring.Rolling(v, substring.BASES[0])
    assert h(np.array([30]), np.array([40])) == h(np.array([5]), np.array([15])) == h.all(10)[5] and len(np.unique(h.all(3))) == 40
    small = r.integers(0, 4, 60)
    for w in (1, 2, 7, 28):
        assert substring.first_smallest(small, w).tolist() == [i + int(np.argmin(small[i : i + w])) for i in range(60 - w + 1)]
