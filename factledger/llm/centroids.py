"""Centroid clustering of integer vectors (Lloyd's rounds), nearest centroids found by PCA-rotated filtering.

Each vector is turned into whole numbers once and stored with its ``LEADING`` first coordinates in the basis of the
principal components of all vectors and the norm of the rest. For a vector x and a centroid c with leading coordinates y
and z and norms of the rest r and s, (y - z)^2 + (r - s)^2 is at most (x - c)^2. The centroid with the least such bound is
measured in whole numbers; only those whose bound, less an allowance for rounding, is no larger than that distance are
measured too. Distances, sums, floors and ties are whole numbers throughout, so results don't depend on the basis, on the
order of rows or on how they are partitioned.

What a round sends is one row of sums for each centroid and task, added up by Spark, and then one row a centroid to the
driver (``k`` rows). The basis needs one row of sums for each pair of components, whatever the number of vectors. A cluster
that holds a third of all rows is summed in the tasks that hold its rows.

Vectors that are null, have other than ``dim`` components, or hold a null, NaN or infinite one are left out. Rows without
id are clustered, but are never first centroids. Rows that repeat count each. Fewer than ``k`` vectors make fewer
centroids; none give an empty result. Other columns are not read. A component beyond ``MOST`` in size, whose squared
distance might not fit a long, is an error, as is a sum that doesn't fit one: nothing wraps around.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import column, stored

LEADING = 12  # rotated coordinates that are stored
MOST = 1 << 27  # of a whole-number component
PAIRS = 20_000  # of vectors and centroids that are measured at a time


# ------------------------------------------------------------------------------------------------------------ algorithm


def rotated(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading coordinates and the norm of the rest of each row."""
    centred = x - mean
    y = centred @ basis
    rest = np.einsum("ij,ij->i", centred, centred) - np.einsum("ij,ij->i", y, y)
    return y, np.sqrt(np.maximum(rest, 0.0))


def nearest(x: np.ndarray, y: np.ndarray, rest: np.ndarray, centres: np.ndarray, cy: np.ndarray, crest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row the nearest centroid (the smaller number of equally near ones) and its squared distance, both whole
    numbers; and how many distances were measured."""
    bound = ((y * y).sum(1) + rest * rest)[:, None] + ((cy * cy).sum(1) + crest * crest)[None, :]
    slack = 1e-9 * (bound + 1)  # far above what rounding can do to sums of squares of this size
    bound -= 2 * (y @ cy.T + rest[:, None] * crest[None, :])
    guess = bound.argmin(1)
    best = ((x - centres[guess]) ** 2).sum(1)
    open_ = bound - slack <= best[:, None]
    open_[np.arange(len(x)), guess] = False
    row, centre = np.nonzero(open_)
    cluster = guess.copy()
    for at in range(0, len(row), PAIRS):
        r, c = row[at : at + PAIRS], centre[at : at + PAIRS]
        d = ((x[r] - centres[c]) ** 2).sum(1)
        near = d <= best[r]  # few; in order of rows and then of centroids
        for i, j, n in zip(r[near].tolist(), c[near].tolist(), d[near].tolist(), strict=True):
            if n < best[i] or (n == best[i] and j < cluster[i]):
                best[i], cluster[i] = n, j
    return cluster, best, len(x) + len(row)


# ------------------------------------------------------------------------------------------------------------------ plan


def kept_vectors(vectors: DataFrame, dim: int, vector: str = "embedding") -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is above all
    return F.coalesce((F.size(v) == dim) & finite, F.lit(False))


def whole_vectors(vectors: DataFrame, dim: int, scale: float, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, floor(scale * component), of the vectors that are kept."""
    x = F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    return vectors.where(kept_vectors(vectors, dim, vector)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def first_centroids(whole: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids; repeated ids in the order of their components."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r.x) for r in whole.where("vec_id is not null").select("x", mark.alias("mark")).orderBy("mark", "x").limit(k).collect()]


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return column(batch, name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _checked(x: np.ndarray) -> np.ndarray:
    if len(x) and max(abs(int(x.min())), abs(int(x.max()))) > MOST:
        raise ValueError(f"a component is beyond {MOST}: squared distances may not fit a long")
    return x


def principal(whole: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of all vectors: sums of products by task, added up by Spark."""
    upper = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = _checked(_matrix(batch, "x", dim)).astype(np.float64)
            n, total, product = n + len(x), total + x.sum(0), product + x.T @ x
        if n:
            values = np.r_[float(n), total, product[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "value"])

    sums = whole.select("x").mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").collect()
    if not sums:
        return np.zeros(dim), np.eye(dim)[:, :LEADING]
    values = np.array([r.value for r in sums])
    n, total = values[0], values[1 : dim + 1]
    product = np.zeros((dim, dim))
    product[upper] = values[dim + 1 :]
    product = product + np.triu(product, 1).T
    mean = total / n
    _, directions = np.linalg.eigh(product / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(directions[:, ::-1][:, :LEADING])


def with_coordinates(whole: DataFrame, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """``vec_id``, ``x`` (int), ``y`` (leading coordinates) and ``rest``."""
    dim, leading = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _checked(_matrix(batch, "x", dim))
            y, rest = rotated(x.astype(np.float64), mean, basis)
            lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.ravel(), kind))
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), lists(x, pa.int32()), lists(y, pa.float64()), pa.array(rest)], ["vec_id", "x", "y", "rest"])

    return whole.mapInArrow(run, "vec_id long, x array<int>, y array<double>, rest double")


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its vectors, their clusters and their distances."""
    dim, leading = basis.shape
    cy, crest = rotated(centres.astype(np.float64), mean, basis)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, "x", dim).astype(np.int64)
            cluster, distance, _ = nearest(x, _matrix(batch, "y", leading), column(batch, "rest").to_numpy(), centres, cy, crest)
            yield batch, x, cluster, distance


def round_sums(known: DataFrame, centres: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> DataFrame:
    """``cluster``, ``n`` and the sums of the components of its vectors, of clusters that aren't empty."""
    k, dim = centres.shape
    names = [f"s{i}" for i in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for _, x, cluster, _ in _assigned(batches, centres, mean, basis):
            order = np.argsort(cluster, kind="stable")
            used, first = np.unique(cluster[order], return_index=True)
            total[used] += np.add.reduceat(x[order], first)
            n += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *[pa.array(total[used, i]) for i in range(dim)]], ["cluster", "n", *names])

    sums = known.select("x", "y", "rest").mapInArrow(run, "cluster long, n long, " + ", ".join(f"{x} long" for x in names))
    return sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2:", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of each
    vector that is kept."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, dim, scale, vector)
    centres = np.array(first_centroids(whole, k, salt), np.int64).reshape(-1, dim)
    if not len(centres):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    mean, basis = principal(whole, dim)
    known = stored(with_coordinates(whole, mean, basis), "vectors")
    for _ in range(rounds):
        moved = centres.copy()
        for r in round_sums(known, centres, mean, basis).collect():  # k rows at most
            moved[r.cluster] = [s // r.n for s in r[2:]]
        centres = moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found, distance in _assigned(batches, centres, mean, basis):
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), pa.array(found, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    final = stored(known.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    marks = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist())]
    sums = {r.cluster: r.total for r in final.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    every = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), mark) for i, mark in marks], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(every), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
