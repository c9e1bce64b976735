"""Overlaps of spans against every pair, and how many pairs the join compares."""

import random

from pyspark.sql import functions as F

from factledger.operators import spans

SCHEMA = "k string, {x}_id long, {x}_start long, {x}_end long"


def frames(spark, left, right):
    return spark.createDataFrame(left, SCHEMA.format(x="l")), spark.createDataFrame(right, SCHEMA.format(x="r"))


def drawn(seed, n, places, most):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = rng.randrange(-places, places)
        out.append((rng.choice("ab"), i, at, at + rng.choice([0, 1, 1, 2, 3, rng.randrange(1, most), -2])))
    return out


def every_pair(left, right):
    out = []
    for k, i, a, b in left:
        for k2, j, c, d in right:
            if k == k2 and None not in (k, a, b, c, d) and a < b and c < d and min(b, d) > max(a, c):
                out.append((k, i, j, min(b, d) - max(a, c)))
    return sorted(out)


def test_all_overlaps_and_the_best(spark):
    left, right = drawn(1, 250, 300, 400), drawn(2, 250, 300, 70)
    left += [("a", 900, None, 4), (None, 901, 1, 4), ("a", 902, 5, 5), ("a", 903, -(1 << 40), 1 << 40)]
    right += [("b", 900, 3, None), (None, 901, 1, 4), ("b", 904, -300, 300), right[0]]
    a, b = frames(spark, left, right)
    got = sorted((r.k, r.l_id, r.r_id, r.overlap) for r in spans.overlapping(a, b, ["k"]).collect())
    assert got == every_pair(left, right)
    start = {(k, i): s for k, i, s, _ in right}
    want = {}
    for k, i, j, n in got:
        want[k, i] = min(want.get((k, i), (0, 0, 0)), (-n, start[k, j], j)) if (k, i) in want else (-n, start[k, j], j)
    best = {(r.k, r.l_id): (-r.overlap, r.r_start, r.r_id) for r in spans.best_overlap(a, b, ["k"]).collect()}
    assert best == want


def test_empty_tables(spark):
    a, b = frames(spark, [], [("a", 1, 0, 5)])
    assert spans.best_overlap(a, b, ["k"]).count() == 0
    a, b = frames(spark, [("a", 1, 0, 5)], [])
    assert spans.best_overlap(a, b, ["k"]).count() == 0


def test_one_key_with_many_spans_is_no_product(spark):
    """100,000 spans of one key on either side, of 30 places on average, a few of which cover all: pairs compared are a small
    multiple of those that overlap."""
    n = 100_000
    side = lambda x, seed: spark.range(n).select(
        F.lit("one").alias("k"), F.col("id").alias(f"{x}_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(20 * n)).alias(f"{x}_start"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(60)).alias("n")
    )
    left, right = (side(x, s).withColumn(f"{x}_end", F.when(F.col(f"{x}_id") < 2, 20 * n).otherwise(F.col(f"{x}_start") + 1 + F.col("n"))).drop("n") for x, s in (("l", 1), ("r", 5)))
    pairs = spans.overlapping(left, right, ["k"])
    met = pairs.count()
    whole = spans.compared(left, right, ["k"], "l", "r").count() + spans.compared(right, left, ["k"], "r", "l").count()
    assert 2 * n < met < whole < 12 * met < n * n / 100


def test_keys_of_few_and_of_many_spans(spark):
    """The same best spans whether a key's spans meet by cells or by key; what lies by key isn't shuffled again."""
    left, right = drawn(3, 300, 300, 400), drawn(4, 300, 300, 70)
    left, right = left + [("c", *x[1:]) for x in left[:25]], right + [("c", *x[1:]) for x in right[:25]] + [("d", 1, 0, 9)]
    a, b = frames(spark, left, right)
    want = {}
    start = {(k, i): s for k, i, s, _ in right}
    for k, i, j, n in every_pair(left, right):
        want[k, i] = min(want.get((k, i), (1, 0, 0)), (-n, start[k, j], j))
    got = spans.best_overlap(a, b, ["k"])
    assert {(r.k, r.l_id): (-r.overlap, r.r_start, r.r_id) for r in got.collect()} == want
    c, d = a.where("k = 'c'").repartition("k"), b.where("k = 'c'").repartition("k")
    plan = spans.best_overlap(c, d, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "__cell" not in plan and plan.count("Exchange hashpartitioning") <= 2
