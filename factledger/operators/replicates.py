"""Sums over resampled units in one pass: n units cost n rows, however many rounds there are.

Each unit has a seed, the md5 of its key; each round has a cubic polynomial over the integers modulo a prime, its
coefficients md5s of the round. The polynomial's value at the seed is the unit's uniform number in that round, so any four
units are independent in a round, rounds are independent of each other, and any engine can repeat the draws. A task goes
through its units in blocks, keeps one vector of sums over the rounds, and gives it as one row a round; Spark adds the
vectors of the tasks. What a task holds is a block of ``CELLS`` draws and that vector."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
CELLS = 1 << 20  # draws of a block
GROUPS = 64  # groups whose vectors a task keeps before it gives them away

#: A Poisson(1) number is the count of these that a uniform number below ``PRIME`` reaches.
POISSON = [t for k in range(14) if (t := math.floor(PRIME * math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) < PRIME]


def seed(*parts: Column) -> Column:
    """A number below ``PRIME`` from the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(PRIME))


def coefficients(rounds: int) -> np.ndarray:
    """Four for each round, the highest power's first."""
    found = [[int(md5(f"{k}|{b}".encode()).hexdigest()[:15], 16) % PRIME for b in range(rounds)] for k in range(4)]
    return np.array(found, dtype=np.int64).reshape(4, rounds)


def uniforms(seeds: np.ndarray, poly: np.ndarray) -> np.ndarray:
    """A row for each seed, a column for each round."""
    x = np.broadcast_to(poly[0], (len(seeds), poly.shape[1]))
    for c in poly[1:]:
        x = (x * seeds[:, None] + c) % PRIME
    return x


def poisson(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, dtype=np.int8)
    for t in POISSON:
        out += x >= t
    return out


def replicate_sums(units: DataFrame, values: dict[str, Column], rounds: int, *parts: Column, by: str | None = None) -> DataFrame:
    """``b`` (0 and on) and the sum of each value over the units as round b has drawn them, with ``by`` in front where it is
    given: each of its values then has sums of its own.

    A unit, which the parts name, counts as often as a Poisson number of mean 1 says. That is drawing with replacement
    but for the number of draws, which varies by a share of 1/sqrt(n) and falls out of a ratio of two sums. Rows of one unit are
    drawn together. A null value counts as 0, rows without ``by`` don't count, and no rows give none."""
    names, group = list(values), F.lit("") if by is None else F.col(by)
    rows = units.select(group.alias("group"), seed(*parts).alias("seed"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()]).where("group is not null")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        poly, size, held = coefficients(rounds), max(1, CELLS // max(1, rounds)), {}

        def given() -> Iterator[pd.DataFrame]:
            for g, total in held.items():
                yield pd.DataFrame({"group": g, "b": np.arange(rounds), **{k: total[:, i] for i, k in enumerate(names)}})
            held.clear()

        for batch in batches:
            for g, part in batch.groupby("group", sort=False):
                seeds, own = part["seed"].to_numpy(), part[names].to_numpy()
                if g not in held:
                    if len(held) >= GROUPS:
                        yield from given()
                    held[g] = np.zeros((rounds, len(names)))
                for at in range(0, len(part), size):
                    held[g] += poisson(uniforms(seeds[at : at + size], poly)).T.astype(float) @ own[at : at + size]
        yield from given()

    kind = rows.schema["group"].dataType.simpleString()
    each = rows.mapInPandas(sums, f"`group` {kind}, b long, " + ", ".join(f"`{k}` double" for k in names))
    added = each.groupBy("group", "b").agg(*[F.sum(k).alias(k) for k in names])
    return added.drop("group") if by is None else added.withColumnRenamed("group", by)


def binomial_steps(n: int, p: float) -> tuple[int, np.ndarray]:
    """The distribution of a binomial number on the scale of ``PRIME``: a number is the first of the two plus the count of
    steps that a uniform number reaches. What lies beyond twelve deviations and forty more is left out (below 1e-30)."""
    if n <= 0 or p <= 0:
        return 0, np.empty(0)
    if p >= 1:
        return n, np.empty(0)
    mode, reach = min(n, int((n + 1) * p)), int(12 * math.sqrt(n * p * (1 - p))) + 40
    low, high = max(0, mode - reach), min(n, mode + reach)
    odds, i = math.log(p) - math.log1p(-p), np.arange(low + 1, high + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + odds)])
    shares = np.exp(logs - logs.max())
    return low, np.floor(np.cumsum(shares)[:-1] / shares.sum() * PRIME)


def binomial_sums(units: DataFrame, n: str, chance: str, rounds: int, *parts: Column) -> DataFrame:
    """``b`` and ``total``: the sum over the units of a binomial number of n trials, drawn anew in each round by one look-up in
    the unit's distribution, which is made once. Units without trials or chance count as 0."""
    rows = units.select(F.col(n).cast("long").alias("n"), F.col(chance).cast("double").alias("p"), seed(*parts).alias("seed")).where("n > 0 and p > 0")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        poly, total, any_unit = coefficients(rounds), np.zeros(rounds, dtype=np.int64), False
        for batch in batches:
            for trials, p, s in zip(batch["n"], batch["p"], batch["seed"], strict=True):
                low, steps = binomial_steps(trials, p)
                total += low + np.searchsorted(steps, uniforms(np.array([s]), poly)[0], side="right")
                any_unit = True
        if any_unit:
            yield pd.DataFrame({"b": np.arange(rounds), "total": total})

    return rows.mapInPandas(sums, "b long, total long").groupBy("b").agg(F.sum("total").alias("total"))
