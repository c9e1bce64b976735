import hashlib
import math
import random

import numpy as np
import pytest

from factledger.llm import centroids


def plain(rows, k=40, rounds=5, dim=64, scale=256):
    """The contract's words, one vector at a time."""
    kept = [(i, [math.floor(scale * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    mark = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted((r for r in kept if r[0] is not None), key=lambda r: (mark(r[0]), r[1]))[:k]]
    if not centres:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    sums = [sum(d for d, c in found if c == j) for j in range(len(centres))]
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted((i if i is not None else -1, c, d, sums[c], sum(sums), marks[c]) for (i, _), (d, c) in zip(kept, found))


def run(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, x double").repartition(3)
    return sorted((r.vec_id if r.vec_id is not None else -1, *r[1:]) for r in centroids.cluster(df, **how).collect())


def test_brute_force(spark):
    rng = random.Random(1)
    middle = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(middle)]) for i in range(300)]
    rows += [(i, list(rows[0][1])) for i in range(300, 500)]  # copies: a hot cluster, and ties of equal centroids
    rows += [rows[3], rows[3], (None, [0.5] * 64), (900, [0.0] * 63), (901, None), (902, [0.1] * 63 + [None]), (903, [0.1] * 63 + [float("nan")]), (904, [float("-inf")] * 64), (905, [])]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [(-1.0) ** i * (i % 3)] * 4) for i in range(n)] + [(99, None)]
    assert run(spark, rows, dim=4) == plain(rows, dim=4)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5), float(i % 2)]) for i in range(60)]  # many vectors halfway between centroids, some centroids equal
    assert run(spark, rows, "float", k=20, dim=2, scale=2.0) == plain(rows, k=20, dim=2, scale=2)


def test_large_components(spark):
    rows = [(i, [float((i * 37 + j * 11) % 1001 - 500) * 1024.0 for j in range(8)]) for i in range(50)]
    assert run(spark, rows, k=5, dim=8) == plain(rows, k=5, dim=8)
    with pytest.raises(Exception, match="may not fit a long"):
        run(spark, [(1, [1e30] * 8)], dim=8)


def test_filter_leaves_few_distances():
    """On clusters the bound rules most centroids out, and what it leaves holds the nearest."""
    rng = np.random.default_rng(0)
    middle = rng.normal(0, 200, (40, 64)).astype(np.int64)
    x = middle[rng.integers(0, 40, 5000)] + rng.normal(0, 30, (5000, 64)).astype(np.int64)
    mean = x.mean(0)
    basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, : centroids.LEADING]
    y, rest = centroids.rotated(x.astype(float), mean, basis)
    cy, crest = centroids.rotated(middle.astype(float), mean, basis)
    found, distance, measured = centroids.nearest(x, y, rest, middle, cy, crest)
    every = ((x[:, None, :] - middle[None]) ** 2).sum(2)
    assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 2 * len(x)
