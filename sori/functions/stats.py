"""Statistical expressions over columns. They stay in the JVM; those that fold arrays are interpreted row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sori.constants import FDR_Q


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, carried eight steps on, where it is exact to doubles."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + F.lit(0.9189385332046727) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = F.lit(1.0)
    for k in range(1, 9):
        product = product * (n.cast("double") + k)
    return series - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def fisher_greater(a: Column, n1: Column, c: Column, n2: Column) -> Column:
    """One-sided Fisher test: chance of ``a`` or more of ``n1`` when ``a + c`` of ``n1 + n2`` are drawn at random.

    Above the mode the upper tail is summed, below it one minus the lower tail, in both cases from the largest term
    away from the mode, each term by its ratio to the one before. Terms beyond nine deviations of the start are under
    1e-17 of the sum, so a row takes a number of steps like the square root of its counts, and no sum starts from a
    term that has underflowed while later ones have not.
    """
    a, n1, m, total = (x.cast("double") for x in (a, n1, a + c, n1 + n2))
    chosen = lambda n, k, sign: F.struct(n.alias("n"), k.alias("k"), F.lit(sign).alias("sign"))
    # one fold over the three binomials, so that the long series stands in the plan once and not nine times
    log_term = lambda k: F.aggregate(F.array(chosen(m, k, 1.0), chosen(total - m, n1 - k, 1.0), chosen(total, n1, -1.0)), F.lit(0.0), lambda s, x: s + x["sign"] * log_choose(x["n"], x["k"]))
    share = F.try_divide(m, total)
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(n1 * share * (1 - share) * F.try_divide(total - n1, total - 1), F.lit(0.0))))
    mode = F.floor((n1 + 1) * (m + 1) / (total + 2))
    upper, steps = a > mode, F.ceil(deviation * 9) + 40
    left, right = F.greatest(F.lit(0.0), n1 + m - total), F.least(n1, m)
    up = lambda k: (m - k) * (n1 - k) / ((k + 1) * (total - m - n1 + k + 1))
    down = lambda k: k * (total - m - n1 + k) / ((m - k + 1) * (n1 - k + 1))
    first = F.when(upper, a).otherwise(a - 1)
    count = F.least(steps, F.when(upper, right - a).otherwise(a - 1 - left)).cast("int")
    step = lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * F.when(upper, up(a + i)).otherwise(down(a - 1 - i))).alias("term"))
    start = F.struct(F.lit(0.0).alias("sum"), F.exp(log_term(first)).alias("term"))
    tail = F.when(count >= 0, F.aggregate(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), start, step, lambda s: s["sum"])).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(upper, tail).otherwise(1 - tail)))


def benjamini_hochberg(tests: DataFrame, family: list[str], p: str = "p_value", q: float = FDR_Q) -> DataFrame:
    """Adds bh_significant: the step-up procedure within each family; equal p-values share the higher rank."""
    whole = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    upto = whole.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tests.withColumn("_r", F.count("*").over(upto)).withColumn("_m", F.count("*").over(whole))
    rows = rows.withColumn("_k", F.max(F.when(F.col(p) <= F.col("_r") / F.col("_m") * F.lit(q), F.col("_r"))).over(whole))
    return rows.withColumn("bh_significant", F.coalesce(F.col("_r") <= F.col("_k"), F.lit(False))).drop("_r", "_m", "_k")


def q_values(tests: DataFrame, family: list[str], p: str = "p_value") -> DataFrame:
    """Adds q_value: the smallest p * m / rank from this p-value on, at most 1."""
    whole = Window.partitionBy(*family)
    upto = whole.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tests.withColumn("_r", F.count("*").over(upto)).withColumn("_m", F.count("*").over(whole))
    after = whole.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("q_value", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(after))).drop("_r", "_m")


def jensen_shannon_bits(x: Column, y: Column) -> Column:
    """Jensen–Shannon divergence of two arrays of counts, in bits; 0 if either is empty."""
    sx, sy = (F.aggregate(v, F.lit(0.0), lambda s, n: s + n) for v in (x, y))
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    parts = F.zip_with(x, y, lambda a, b: (term(a / sx, (a / sx + b / sy) / 2) + term(b / sy, (a / sx + b / sy) / 2)) / 2)
    return F.when((sx == 0) | (sy == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; null if n is 0."""
    p, zz = F.try_divide(hits.cast("double"), n), z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half
