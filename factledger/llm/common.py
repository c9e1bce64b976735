"""Helpers that the corpus operators share: reading, scratch tables and vectorised word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.sources.scratch import discard, new_path, shared_dir, stored  # noqa: F401  what the operators share

# ----------------------------------------------------------------------------------------------- reading and writing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_set(hashes: DataFrame, most: int) -> np.ndarray:
    """Bits of the values of the column ``h`` (long), about 16 a value and at most ``most`` (a power of two).

    That bounds what the driver gathers and what is broadcast; a fuller set only lets more through."""
    size, n = 1 << 20, hashes.count()
    while size < min(16 * n, most):
        size *= 2
    place = F.pmod("h", F.lit(size))
    words = hashes.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def has_bit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value (unsigned) is in the set: true for every value that is, false for most others."""
    at = values & np.uint64(64 * len(bits) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


FILTER_BITS = 1 << 25  # 4 MB, however many ids there are


def possibly(ids: DataFrame, name: str):
    """A filter for a column of longs: true for every id of ``ids``, false for most others.

    It only sees the id, so texts are not sent to Python."""
    shared = ids.sparkSession.sparkContext.broadcast(bit_set(ids.select(F.xxhash64(F.col(name).cast("long")).alias("h")), FILTER_BITS))

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        return pd.Series(has_bit(shared.value, h.to_numpy(np.int64).view(np.uint64)))

    return lambda x: known(F.xxhash64(x.cast("long")))


SLOTS = 1 << 30


def slot(mark: Column, salt: int = 0) -> Column:
    """A number below ``SLOTS`` drawn from a row's mark."""
    return F.pmod(F.xxhash64(mark, F.lit(salt)), F.lit(SLOTS))


def mark_of(names: list[str]) -> Column:
    """A hash of the columns and of which of them are null: rows differ in it unless they repeat."""
    return F.xxhash64(*[x for c in quoted(names) for x in (c, c.isNull())])


def drawn(rows: DataFrame, below: Column, names: list[str]) -> DataFrame:
    """``names`` of about a share of the distinct rows: those whose slot is ``below``. Rows that repeat, and rows without
    id, are not drawn together: a row's slot hangs on all of ``names``, and a repeated row comes once, however often it
    is there (it is put together where it is read, before any shuffle)."""
    chosen = rows.select(*quoted(names), mark_of(names).alias(mark := fresh(names, "mark")), below.alias(limit := fresh(names, "below"))).where(slot(F.col(mark)) < F.col(limit))
    return chosen.groupBy(mark).agg(F.first(F.struct(*quoted(names))).alias("x")).select("x.*")


# ------------------------------------------------------------------------------------------------ batches inside tasks


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``limit`` bytes of text, so that vectorised work needs bounded memory.

    Only a single text longer than the limit makes a larger slice. After the last one the worker's free memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.fromiter((len(x) if x is not None else 0 for x in column.cast(pa.large_binary()).to_pylist()), np.int64, len(column)) if column.null_count else _lengths(column)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    release()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Gives free memory back to the system. Workers serve all stages of a job: what one stage leaves in their allocators
    would stay beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.binary_length(column.cast(pa.large_binary()))).astype(np.int64)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names, whatever marks are in them."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in names]


def fresh(names: list[str], name: str) -> str:
    """``name``, with as many marks before it as make it unlike all ``names``."""
    while name.lower() in {x.lower() for x in names}:
        name = "_" + name
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object], good: Callable[[object], bool] = lambda _: True):
    """What a worker keeps from task to task under a name. Workers outlive the stages of a job: asking for one thing
    drops any other, so that a stage does not pay for the tables of the stages before it."""
    if name not in _KEPT or not good(_KEPT[name]):
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


# ------------------------------------------------------------------------------------------------------- hashes of words

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""

    def make() -> list[np.ndarray]:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(max(n, 1_200_000), base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out

    up, down = kept("powers", make, lambda x: len(x[0]) >= n)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """Words of many texts, as arrays: 64-bit hash, document, byte range in the joined bytes.

    A word is a run of anything but the six ASCII spaces; A-Z are lower-cased, nothing else is changed."""

    def __init__(self, texts: list[str], strip: np.ndarray | None = None):
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8).copy()
        upper = (joined >= 65) & (joined <= 90)
        joined[upper] += 32
        self.bytes = joined
        sizes = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
        self.doc_start = np.cumsum(sizes) - sizes
        gap = (_SPACE if strip is None else strip)[joined]
        edge = np.flatnonzero(np.diff(np.r_[True, gap].astype(np.int8)))
        if len(edge) % 2:
            edge = np.r_[edge, len(joined)]
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _powers(len(joined) + 1)
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.n_docs = len(texts)
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))  # words of document i: first[i] to first[i+1]


_LANE = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)]


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of n words inside one document (n at most 8)."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(h) - n + 1
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total += h[k : k + size] * _LANE[k]
    keep = words.doc[:size] == words.doc[n - 1 :]
    return mix(total[keep]), words.doc[:size][keep]


def shingle_sets(texts: list[str], n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; with fewer words, one hash of all of them."""
    words = Words(texts)
    value, doc = grams(words, n)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        count = words.first[i + 1] - words.first[i]
        if count >= n:
            own = np.sort(value[at[i] : at[i + 1]])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif count:
            own = words.hash[words.first[i] : words.first[i + 1]]
            total = np.full(1, count, np.uint64) + (own * np.array(_LANE[:count])).sum(dtype=np.uint64)
            out.append(mix(total + np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All values of the arrays and their lengths."""
    sizes = np.fromiter((len(x) for x in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes
