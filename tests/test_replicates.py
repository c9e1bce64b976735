"""Resampling in one pass: the weights against a plain form, drawing with replacement and exact distributions."""

import math
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from factledger.operators import evaluation, replicates


def number(text):
    return int(md5(text.encode()).hexdigest()[:15], 16) % replicates.PRIME


def weight(key, b):
    x, s = 0, number(key)
    for k in range(4):
        x = (x * s + number(f"{k}|{b}")) % replicates.PRIME
    u, count, term = x / replicates.PRIME, 0, math.exp(-1)
    total = term
    while u >= total:
        count += 1
        term /= count
        total += term
    return count


def test_sums_equal_a_plain_loop(spark):
    rows = [(f"g{i % 3}", f"k{i}", i, float(i % 7)) for i in range(200)] + [("g0", "none", None, 5.0), (None, "k1", 1, 1.0)]
    df = spark.createDataFrame(rows, "g string, k string, n long, v double").repartition(5)
    got = {(r.g, r.b): (r.n, r.v) for r in replicates.replicate_sums(df, {"n": F.col("n"), "v": F.col("v")}, 6, F.lit("s"), F.col("k"), by="g").collect()}
    want = {}
    for g, k, n, v in rows:
        for b in range(6):
            if g is not None:
                w, old = weight(f"s|{k}", b), want.get((g, b), (0, 0))
                want[g, b] = (old[0] + w * (n or 0), old[1] + w * v)
    assert got == want


def test_weights_are_poisson_and_rounds_apart():
    seeds = np.array([number(f"unit{i}") for i in range(4000)])
    w = replicates.poisson(replicates.uniforms(seeds, replicates.coefficients(50))).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.006
    between = np.corrcoef(w.T)
    assert np.abs(between[~np.eye(50, dtype=bool)]).max() < 0.08


def test_interval_is_that_of_drawing_with_replacement(spark):
    rng = np.random.default_rng(5)
    den = rng.integers(5, 60, 400)
    num = rng.binomial(den, 0.1)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(num, den, strict=True))], "k long, num long, den long")
    got = evaluation.bootstrap(df, "num", "den", "k", 2000).first()
    at = rng.integers(0, 400, (2000, 400))
    low, high = np.quantile(num[at].sum(1) / den[at].sum(1), [0.025, 0.975])
    assert got.rounds == 2000
    assert abs(got.low - low) < 0.1 * (high - low) and abs(got.high - high) < 0.1 * (high - low)


def test_binomial_numbers(spark):
    for n, p in [(1, 0.5), (7, 0.3), (60, 0.98), (500, 0.01)]:
        low, steps = replicates.binomial_steps(n, p)
        cdf = np.cumsum([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
        assert np.allclose(steps / replicates.PRIME, cdf[low : low + len(steps)], atol=1e-9)
        assert low == 0 or cdf[low - 1] < 1e-12
    low, steps = replicates.binomial_steps(10_000_000, 0.25)
    assert len(steps) < 50_000 and abs(low + np.searchsorted(steps, replicates.PRIME / 2) - 2_500_000) < 3
    assert replicates.binomial_steps(5, 1.0)[0] == 5 and len(replicates.binomial_steps(0, 0.5)[1]) == 0
    df = spark.createDataFrame([("a", 30, 0.2), ("b", 4, 1.0), ("c", 0, 0.5), ("d", None, 0.5), ("e", 9, 0.0)], "k string, n long, p double")
    totals = [r.total for r in replicates.binomial_sums(df, "n", "p", 3000, F.col("k")).collect()]
    assert len(totals) == 3000 and abs(np.mean(totals) - 10) < 0.2 and abs(np.var(totals) - 4.8) < 0.6


def test_conditional_test_is_near_the_exact_p(spark):
    pairs = [("u1", 8, 40, 3, 40), ("u2", 5, 30, 2, 60), ("u3", 0, 20, 0, 20), ("u4", 6, 25, 1, 50)]
    rows = [(u, arm, n, d) for u, na, da, nb, db in pairs for arm, n, d in (("a", na, da), ("b", nb, db))]
    df = spark.createDataFrame(rows, "k string, arm string, num long, den long")
    got = evaluation.conditional_test(df, ["k"], "arm", "a", "b", 20_000).first()
    dist = np.ones(1)
    for _, na, da, nb, db in pairs:
        n, p = na + nb, db / (da + db)
        dist = np.convolve(dist, [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
    da, db = sum(x[2] for x in pairs), sum(x[4] for x in pairs)
    events, seen = len(dist) - 1, sum(x[3] for x in pairs) / db - sum(x[1] for x in pairs) / da
    exact = sum(q for k, q in enumerate(dist) if abs(k / db - (events - k) / da) >= abs(seen) - 1e-12)
    assert abs(got.p - exact) < 4 * math.sqrt(exact / 20_000) + 1e-4


def test_no_rows_by_rounds_are_shuffled(spark):
    """A million units and 2,000 rounds: what is shuffled is a vector for each task."""
    units = spark.range(0, 1_000_000, 1, 8).selectExpr("id as k", "id % 3 as num", "3 as den")
    plan = evaluation.bootstrap_many(units, {"r": ("num", "den")}, "k", 2000)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("MapInPandas") == 1
