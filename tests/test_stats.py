import math
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from sori.functions.stats import benjamini_hochberg, fisher_greater, jensen_shannon_bits, wilson
from sori.operators.monthly import permutation_test, product_names, severity

CASES = [(26, 200, 40, 800), (13, 200, 8, 800), (5, 60, 10, 240), (4, 55, 6, 220), (3, 50, 3, 200), (12, 200, 40, 800), (0, 10, 0, 5), (10, 10, 0, 30), (700, 2000, 2500, 9000)]


def exact(a, n1, c, n2):
    m = a + c
    return sum(comb(m, k) * comb(n1 + n2 - m, n1 - k) for k in range(a, min(n1, m) + 1)) / comb(n1 + n2, n1)


def test_fisher_against_integers(spark):
    rows = spark.createDataFrame(CASES, "a long, n1 long, c long, n2 long").withColumn("p", fisher_greater(*map(F.col, ("a", "n1", "c", "n2")))).collect()
    for r in rows:
        assert r.p == pytest.approx(exact(r.a, r.n1, r.c, r.n2), rel=1e-9)


def exact_large(a, n1, c, n2):
    """Exact integers, each term from the one before."""
    m, total = a + c, n1 + n2
    k, end = max(0, n1 + m - total), min(n1, m)
    term, above, whole = comb(m, k) * comb(total - m, n1 - k), 0, comb(total, n1)
    while k <= end:
        above += term if k >= a else 0
        term = term * (m - k) * (n1 - k) // ((k + 1) * (total - m - n1 + k + 1))
        k += 1
    return Fraction(above, whole)


LARGE = [(20, 5000, 4000, 20000), (100, 10000, 8000, 40000), (0, 4000, 3000, 16000), (2500, 10000, 9000, 40000), (1700, 10000, 6000, 40000), (1000, 30000, 3000, 90000), (5000, 20000, 0, 20000)]


def test_fisher_on_large_counts(spark):
    rows = spark.createDataFrame(LARGE, "a long, n1 long, c long, n2 long").withColumn("p", fisher_greater(*map(F.col, ("a", "n1", "c", "n2")))).collect()
    for r in rows:
        assert r.p == pytest.approx(float(exact_large(r.a, r.n1, r.c, r.n2)), rel=1e-8, abs=1e-300)


def by_weights(a, n1, c, n2):
    """Ratio of sums over terms relative to the mode's, twenty deviations around it."""
    m, total = a + c, n1 + n2
    mode, share = (n1 + 1) * (m + 1) // (total + 2), m / total
    wide = int(20 * math.sqrt(n1 * share * (1 - share) * (total - n1) / total)) + 50
    up, down = [1.0], []
    for k in range(mode, min(mode + wide, n1, m)):
        up.append(up[-1] * (m - k) * (n1 - k) / ((k + 1) * (total - m - n1 + k + 1)))
    last = 1.0
    for k in range(mode, max(mode - wide, 0, n1 + m - total), -1):
        last *= k * (total - m - n1 + k) / ((m - k + 1) * (n1 - k + 1))
        down.append(last)
    terms = {mode + i: w for i, w in enumerate(up)} | {mode - 1 - i: w for i, w in enumerate(down)}
    return math.fsum(w for k, w in terms.items() if k >= a) / math.fsum(terms.values())


def test_fisher_on_very_large_counts(spark):
    cases = [(1000, 100_000, 20_000, 400_000), (2_001_000, 10_000_000, 8_000_000, 40_000_000), (1_999_000, 10_000_000, 8_000_000, 40_000_000), (2_010_000, 10_000_000, 8_000_000, 40_000_000), (20_002_000, 100_000_000, 80_000_000, 400_000_000), (50_000_000, 100_000_000, 80_000_000, 400_000_000)]
    rows = spark.createDataFrame(cases, "a long, n1 long, c long, n2 long").withColumn("p", fisher_greater(*map(F.col, ("a", "n1", "c", "n2")))).collect()
    for r in rows:
        want = 0.0 if r.a == 50_000_000 else by_weights(r.a, r.n1, r.c, r.n2)
        assert r.p == pytest.approx(want, rel=1e-5, abs=1e-12)


def test_bh_toy_and_families(spark):
    p = [("x", i, v) for i, v in enumerate([0.001, 0.008, 0.030, 0.045, 0.060])] + [("A", 9, 0.02)] + [("B", 10 + i, 0.9) for i in range(9)]
    got = {r.i: r.bh_significant for r in benjamini_hochberg(spark.createDataFrame(p, "f string, i int, p_value double"), ["f"]).collect()}
    assert [got[i] for i in range(5)] == [True, True, True, False, False]
    assert got[9] and not any(got[10 + i] for i in range(9))


def test_divergence_and_severity(spark):
    rows = [([50.0, 30.0, 20.0], [50.0, 30.0, 20.0]), ([100.0, 0.0, 0.0], [0.0, 0.0, 100.0]), ([0.0, 0.0, 0.0], [1.0, 2.0, 3.0])]
    got = [r.j for r in spark.createDataFrame(rows, "x array<double>, y array<double>").select(jensen_shannon_bits(F.col("x"), F.col("y")).alias("j")).collect()]
    assert got == pytest.approx([0.0, 1.0, 0.0])
    levels = spark.createDataFrame([(0.05, True), (0.15, True), (0.25, True), (0.25, False)], "e double, s boolean").select(severity(F.col("e"), F.lit(0.0), F.col("s")).alias("v")).collect()
    assert [r.v for r in levels] == ["SAFE", "CAUTION", "CRISIS", "SAFE"]


def test_permutation(spark):
    r = permutation_test(spark.createDataFrame([("p", "a", "b", [80.0, 10.0, 10.0], [10.0, 10.0, 80.0]), ("q", "a", "b", [0.0, 0.0], [1.0, 2.0])], "product string, channel_a string, channel_b string, x array<double>, y array<double>"), b=999).collect()
    assert r[0].jsd > r[0].baseline and r[0].p_value < 0.05
    assert (r[1].jsd, r[1].baseline, r[1].p_value) == (0.0, 0.0, 1.0)


def test_wilson_and_names(spark):
    low, high = wilson(F.lit(5), F.lit(10))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (r.l, r.h) == pytest.approx((0.2366, 0.7634), abs=1e-4)
    names = [("g", "NAVER", "a"), ("g", "NAVER", "a"), ("g", "NAVER", "b"), ("g", "COUPANG", "b"), ("g", "ZIGZAG", "c")]
    assert product_names(spark.createDataFrame(names, "product string, channel string, name string")).first().product_name == "c"


def test_exact_test_over_all_tables(spark):
    """Against plain enumeration with exact integers; far apart, equal, empty and one-sided tables; large counts in few steps."""
    from sori.operators.monthly import exact_test

    def bits(a, b, n, k):
        part = lambda p, q: p * math.log2(2 * p / (p + q)) if p else 0.0
        return sum(part(p, q) + part(q, p) for p, q in ((a / n, b / k), (1 - a / n, 1 - b / k))) / 2

    cases = [(40, 30, 42, 45), (3, 9, 20, 60), (10, 30, 100, 300), (0, 5, 7, 9), (0, 0, 4, 5), (7, 9, 7, 9), (200, 10, 400, 500), (1, 900, 3, 1000), (5, 5, 5, 50), (900, 20, 1000, 1000)]
    got = spark.createDataFrame(cases, "x long, y long, n long, k long").select(*(c.alias(a) for c, a in zip(exact_test(*map(F.col, "xynk")), ("baseline", "p"), strict=True))).collect()
    for (x, y, n, k), r in zip(cases, got, strict=True):
        m, seen = x + y, bits(x, y, n, k)
        chance = {i: comb(m, i) * comb(n + k - m, n - i) for i in range(max(0, m - k), min(n, m) + 1)}
        whole = comb(n + k, n)
        assert r.baseline == pytest.approx(sum(w / whole * bits(i, m - i, n, k) for i, w in chance.items()), rel=1e-9, abs=1e-15)
        assert r.p == pytest.approx(float(Fraction(sum(w for i, w in chance.items() if bits(i, m - i, n, k) >= seen - 1e-12), whole)), rel=1e-8)
    large = spark.range(1).select(*exact_test(F.lit(20_100_000), F.lit(19_900_000), F.lit(100_000_000), F.lit(100_000_000))).first()  # 40 million tables
    assert large[0] == pytest.approx(1 / (8 * math.log(2) * 100_000_000 * 0.5), rel=0.5) and large[1] < 1e-200
