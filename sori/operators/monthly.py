"""Monthly aggregates: ratios, drift, divergence between channels, product names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sori import constants as C
from sori.functions.stats import benjamini_hochberg, fisher_greater, jensen_shannon_bits, log_choose


def sentiment_ratios(docs: DataFrame) -> DataFrame:
    """Per product, month and attribute: counts and ratios of the three sentiments."""
    rows = docs.groupBy("product", F.trunc("day", "month").alias("month"), "aspect").agg(*(F.count_if(F.col("sentiment") == s).alias(n) for s, n in ((1, "pos"), (0, "neu"), (-1, "neg"))))
    n = F.col("pos") + F.col("neu") + F.col("neg")
    return rows.select("product", "month", "aspect", "pos", "neu", "neg", *(F.coalesce(F.try_divide(c, n), F.lit(0.0)).alias(f"{c}_ratio") for c in ("pos", "neu", "neg")))


def drift(ratios: DataFrame) -> DataFrame:
    """Change of the negative ratio against the month before (nothing counts as 0), RISK from the threshold on."""
    before = ratios.select("product", "aspect", F.add_months("month", 1).alias("month"), F.col("neg_ratio").alias("before"))
    rows = ratios.join(before, ["product", "aspect", "month"], "left").withColumn("drift", F.col("neg_ratio") - F.coalesce("before", F.lit(0.0)))
    return rows.select("product", "month", "aspect", "drift", F.when(F.col("drift") >= C.DRIFT_RISK, "RISK").otherwise("SAFE").alias("status"))


def channel_pairs(docs: DataFrame) -> DataFrame:
    """Per product all pairs of the three channels: negative counts by attribute (x, y), their sums, the gate's hold_reason.

    A channel without negatives counts as empty.
    """
    counts = F.array(*(F.count_if((F.col("sentiment") == -1) & (F.col("aspect") == a)).cast("double") for a in C.ASPECTS))
    rows = docs.groupBy("product", F.upper("channel").alias("channel")).agg(counts.alias("v"))
    wide = rows.groupBy("product").agg(*(F.max(F.when(F.col("channel") == c, F.col("v"))).alias(c) for c in C.CHANNELS))
    zero = F.array(*[F.lit(0.0)] * len(C.ASPECTS))
    pairs = [(a, b) for i, a in enumerate(C.CHANNELS) for b in C.CHANNELS[i + 1 :]]
    cells = F.array(*(F.struct(F.lit(a).alias("channel_a"), F.lit(b).alias("channel_b"), F.coalesce(a, zero).alias("x"), F.coalesce(b, zero).alias("y")) for a, b in pairs))
    rows = wide.select("product", F.inline(cells))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, n: s + n)
    rows = rows.withColumn("n_a", total("x").cast("long")).withColumn("n_b", total("y").cast("long"))
    return rows.withColumn("hold_reason", divergence_gate(F.col("n_a"), F.col("n_b")))


def divergence_gate(n_a, n_b):
    """Why a pair is not tested: an empty channel, or too few in both; null if it is."""
    return F.when(F.least(n_a, n_b) < 1, "EMPTY_CHANNEL").when(n_a + n_b < C.JSD_TOTAL, "INSUFFICIENT_SAMPLE")


def channel_divergence(docs: DataFrame) -> DataFrame:
    """:func:`channel_pairs` with the divergence of those that pass the gate."""
    rows = channel_pairs(docs)
    return rows.withColumn("jsd", F.when(F.col("hold_reason").isNull(), jensen_shannon_bits(F.col("x"), F.col("y")))).drop("x", "y")


def finalized(pairs: DataFrame) -> DataFrame:
    """Second phase over all pairs: one family of the tested ones, then excess and severity; held pairs stay, with nulls.

    ``pairs`` has hold_reason and, where it is null, jsd, baseline and p_value. A row for each product and pair of channels.
    """
    tested = benjamini_hochberg(pairs.where("hold_reason IS NULL"), [])
    tested = tested.withColumn("excess", F.col("jsd") - F.col("baseline")).withColumn("severity", severity(F.col("jsd"), F.col("baseline"), F.col("bh_significant")))
    return tested.unionByName(pairs.where("hold_reason IS NOT NULL"), allowMissingColumns=True)


def severity(jsd, baseline, significant):
    """SAFE, CAUTION or CRISIS from the excess over the null mean."""
    excess = jsd - baseline
    return F.when(~significant | (excess < C.JSD_MIN), "SAFE").when(excess < C.JSD_CRISIS, "CAUTION").otherwise("CRISIS")


def divergence_rollup(pairs: DataFrame) -> DataFrame:
    """Worst pair of each product by severity, then excess, then order of names; whether any is not SAFE. Null if all are held.

    ``pairs`` has product, channel_a, channel_b, severity and excess (both null if held).
    """
    rank = F.when(F.col("severity") == "CRISIS", 2).when(F.col("severity") == "CAUTION", 1).when(F.col("severity") == "SAFE", 0)
    pair = F.struct((-rank).alias("r"), (-F.col("excess")).alias("e"), F.col("channel_a"), F.col("channel_b"), F.col("severity"))
    rows = pairs.groupBy("product").agg(F.min(F.when(rank.isNotNull(), pair)).alias("w"), F.bool_or(rank > 0).alias("crisis"))
    return rows.select("product", F.concat_ws("-", "w.channel_a", "w.channel_b").alias("pair"), F.col("w.severity").alias("severity"), "crisis")


def product_names(labels: DataFrame) -> DataFrame:
    """The name of each group: per channel the commonest (ties: largest name), of these the commonest (ties: ZIGZAG, NAVER, COUPANG, then others by name).

    ``labels`` has product, channel, name.
    """
    n = labels.groupBy("product", "channel", "name").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("product", "channel").orderBy(F.desc("n"), F.desc("name")))).where("r = 1")
    place = F.when(F.col("channel") == "ZIGZAG", 0).when(F.col("channel") == "NAVER", 1).when(F.col("channel") == "COUPANG", 2).otherwise(3)
    votes = top.groupBy("product", "name").agg(F.count("*").alias("votes"), F.min(F.struct(place.alias("p"), "channel")).alias("best"))
    order = Window.partitionBy("product").orderBy(F.desc("votes"), "best")
    return votes.withColumn("r", F.row_number().over(order)).where("r = 1").select("product", F.col("name").alias("product_name"))


def permutation_test(pairs: DataFrame, b: int = 10_000, seed: int = 42) -> DataFrame:
    """Label-permutation test of each pair's divergence: jsd, baseline, p_value. ``pairs`` has product, channel_a, channel_b, x, y.

    Rows are independent, so they spread over the cluster; a row draws multivariate hypergeometric tables of its counts.
    """
    import numpy as np

    def bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        p, q = x / x.sum(-1, keepdims=True), y / y.sum(-1, keepdims=True)
        m = (p + q) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
        return np.clip(parts.sum(-1) / 2, 0, 1)

    def run(frames):
        for f in frames:
            out = []
            for x, y in zip(f.x, f.y, strict=True):
                x, y = np.asarray(x, float), np.asarray(y, float)
                if not x.sum() or not y.sum():
                    out.append((0.0, 0.0, 1.0))
                    continue
                seen = float(bits(x, y))
                draws = np.random.default_rng(seed).multivariate_hypergeometric((x + y).astype(int), int(x.sum()), size=b)
                null = bits(draws.astype(float), x + y - draws)
                out.append((seen, float(null.mean()), float(((null >= seen - 1e-12).sum() + 1) / (b + 1))))
            yield f[["product", "channel_a", "channel_b"]].assign(jsd=[o[0] for o in out], baseline=[o[1] for o in out], p_value=[o[2] for o in out])

    return pairs.select("product", "channel_a", "channel_b", "x", "y").mapInPandas(run, "product string, channel_a string, channel_b string, jsd double, baseline double, p_value double")


def exact_test(x, y, n_x, n_y):
    """(baseline, p_value) of the divergence of two two-way splits, (x, n_x - x) and (y, n_y - y), over all tables of their margins.

    What the permutations of :func:`permutation_test` estimate, for two categories. Divergence is convex in the first's
    count, so the tables at least as far apart as the one seen are two tails, whose ends are found by bisection; their
    chances are Fisher tests. The mean goes from the likeliest count both ways, each weight by its ratio to the one
    before, nine deviations and forty counts far: what lies beyond is under 1e-17 of the sum. Steps grow with the root
    of the counts.
    """
    x, y, n_x, n_y = (c.cast("double") for c in (x, y, n_x, n_y))
    m, total = x + y, n_x + n_y
    low, high, even = F.greatest(F.lit(0.0), n_x + m - total), F.least(n_x, m), F.try_divide(n_x * m, total)
    mode = F.floor((n_x + 1) * (m + 1) / (total + 2)).cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(n_x * m * (total - m) * n_y, total * total * (total - 1)), F.lit(0.0))))
    fixed = F.struct(m.alias("m"), n_x.alias("n_x"), n_y.alias("n_y"), total.alias("total"), low.alias("low"), high.alias("high"), F.coalesce(even, F.lit(0.0)).alias("even"), mode.alias("mode"), (F.ceil(spread * 9) + 40).alias("steps"), (jensen_shannon_bits(F.array(x, n_x - x), F.array(y, n_y - y)) - 1e-12).alias("bar"))
    with_fixed = lambda f: F.element_at(F.transform(F.array(fixed), f), 1)  # noqa: E731  # so that each part stands in the plan once
    bits = lambda t, k: jensen_shannon_bits(F.array(k, t["n_x"] - k), F.array(t["m"] - k, t["n_y"] - (t["m"] - k)))

    def mean(t):
        up = lambda k: (t["m"] - k) * (t["n_x"] - k) / ((k + 1) * (t["total"] - t["m"] - t["n_x"] + k + 1))
        down = lambda k: k * (t["total"] - t["m"] - t["n_x"] + k) / ((t["m"] - k + 1) * (t["n_x"] - k + 1))

        def side(ratio, sign, room):
            step = lambda s, i: F.struct((s["sum"] + s["w"]).alias("sum"), (s["bits"] + s["w"] * bits(t, t["mode"] + i * sign)).alias("bits"), (s["w"] * F.coalesce(ratio(t["mode"] + i * sign), F.lit(0.0))).alias("w"))
            return F.aggregate(F.sequence(F.lit(0), F.least(t["steps"], room).cast("int")), F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("bits"), F.lit(1.0).alias("w")), step)

        above, below = side(up, 1, t["high"] - t["mode"]), side(down, -1, t["mode"] - t["low"])
        both = lambda e: (e["a"]["bits"] + e["b"]["bits"] - bits(t, t["mode"])) / (e["a"]["sum"] + e["b"]["sum"] - 1)  # noqa: E731  # both begin with the mode
        return F.element_at(F.transform(F.array(F.struct(above.alias("a"), below.alias("b"))), both), 1)

    def ends(t):
        """The last count of the lower tail and the first of the upper one; low - 1 and high + 1 if there is none."""
        halve = lambda keep: lambda s, _: keep(s, F.floor((s["in"] + s["out"]) / 2).cast("double"))
        far = lambda k: bits(t, k) >= t["bar"]
        down = lambda s, k: F.when(F.abs(s["out"] - s["in"]) <= 1, s).when(far(k), F.struct(k.alias("in"), s["out"].alias("out"))).otherwise(F.struct(s["in"].alias("in"), k.alias("out")))
        start = lambda a, b: F.struct(a.alias("in"), b.alias("out"))
        middle = F.floor(t["even"]).cast("double")
        left = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start(t["low"] - 1, middle + 1), halve(down))["in"]
        right = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start(t["high"] + 1, middle), halve(down))["in"]
        return F.struct(left.alias("left"), right.alias("right"), t.alias("t"))

    def tails(e):
        t, k, j = e["t"], e["left"], e["right"]
        lower = F.when(k < t["low"], 0.0).otherwise(fisher_greater(t["n_x"] - k, t["n_x"], t["total"] - t["m"] - (t["n_x"] - k), t["n_y"]))
        upper = F.when(j > t["high"], 0.0).otherwise(fisher_greater(j, t["n_x"], t["m"] - j, t["n_y"]))
        return F.when(j - k <= 1, 1.0).otherwise(F.least(F.lit(1.0), lower + upper))

    return with_fixed(mean), F.element_at(F.transform(F.transform(F.array(fixed), ends), tails), 1)


#: Pairs with more tables than this are drawn, not enumerated: the product of (total of an attribute + 1) bounds the work.
MOST_TABLES = 1_000_000


def exact_permutation_test(pairs: DataFrame, key: list[str], categories: int = len(C.ASPECTS)) -> DataFrame:
    """What :func:`permutation_test` estimates, exactly: key, jsd, baseline, p_value over all tables of a pair's margins.

    Divergence is a sum over categories, and so is a table drawn without replacement a chain of hypergeometric draws.
    The state after some categories is how many of x's documents are placed and the sum so far; tables that agree in
    both are one row with their chance. Every category is one explosion and one grouping with partial sums, so the work
    spreads over pairs and tables alike. :func:`exact_test` is the case of two categories in one expression.

    ``pairs`` has the key, x and y (arrays of ``categories`` counts). A pair with an empty side gets 0, 0, 1.
    """
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, n: s + n)
    rows = pairs.select(*key, F.transform("x", lambda v: v.cast("double")).alias("x"), F.transform("y", lambda v: v.cast("double")).alias("y"))
    rows = rows.withColumns({"n": total("x"), "all": total("x") + total("y"), "m": F.zip_with("x", "y", lambda a, b: a + b), "jsd": jensen_shannon_bits(F.col("x"), F.col("y"))})
    fixed = [*key, "n", "all", "m", "jsd"]
    states = rows.where((F.col("n") > 0) & (F.col("all") > F.col("n"))).select(*fixed, F.lit(0.0).alias("used"), F.lit(0.0).alias("bits"), F.lit(1.0).alias("chance"))
    for j in range(categories):
        m, left = F.col("m")[j], F.aggregate(F.slice("m", j + 1, categories), F.lit(0.0), lambda s, v: s + v)
        open_ = F.col("n") - F.col("used")
        low, high = F.greatest(F.lit(0.0), open_ - (left - m)), F.least(m, open_)
        states = states.withColumn("k", F.explode(F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda v: v.cast("double"))))
        p, q = F.col("k") / F.col("n"), (m - F.col("k")) / (F.col("all") - F.col("n"))
        term = lambda v: F.when(v > 0, v * F.log2(2 * v / (p + q))).otherwise(0.0)  # noqa: B023, E731
        chance = F.col("chance") * F.exp(log_choose(m, F.col("k")) + log_choose(left - m, open_ - F.col("k")) - log_choose(left, open_))
        states = states.select(*fixed, (F.col("used") + F.col("k")).alias("used"), F.round(F.col("bits") + (term(p) + term(q)) / 2, 12).alias("bits"), chance.alias("chance"))
        states = states.groupBy(*fixed, "used", "bits").agg(F.sum("chance").alias("chance"))
    at_least = F.when(F.col("bits") >= F.col("jsd") - 1e-10, F.col("chance")).otherwise(0.0)
    tested = states.groupBy(*key, "jsd").agg(F.sum(F.col("bits") * F.col("chance")).alias("baseline"), F.least(F.lit(1.0), F.sum(at_least)).alias("p_value"))
    empty = rows.where((F.col("n") == 0) | (F.col("all") == F.col("n"))).select(*key, F.lit(0.0).alias("jsd"), F.lit(0.0).alias("baseline"), F.lit(1.0).alias("p_value"))
    return tested.unionByName(empty)


def tested_pairs(pairs: DataFrame, most: int = MOST_TABLES) -> DataFrame:
    """jsd, baseline and p_value of each pair: exact where its tables are at most ``most``, by draws beyond."""
    key = ["product", "channel_a", "channel_b"]
    tables = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") + b.cast("double")), F.lit(1.0), lambda s, m: s * (m + 1))
    few = tables <= most
    exact = exact_permutation_test(pairs.where(few), key)
    return exact.unionByName(permutation_test(pairs.where(~few)).select(*exact.columns))
