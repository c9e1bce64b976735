"""Importance resampling of documents towards a target text, by hashed runs of one to three words.

A text's ASCII capitals are lower-cased; words are runs of digits, letters a to z and anything beyond ASCII. A document is
scanned once, as its words with one space before each: the running CRC-32 is kept at the end of each word, and the one
after the space before the next word follows from it. The CRC of a run of words is that at its end, less that at its
beginning shifted by the run's length: CRCs are linear over GF(2), so what stands before the run cancels
(crc(ab) = shift(crc(a), len(b)) xor crc(b)). Shifts are looked up byte by byte in tables of shifts by up to 63 bytes and by
64 bytes times each power of two. No run is ever put together or hashed by itself.

A feature's bucket is its CRC modulo ``BUCKETS``. Counts are of all documents and of all target texts: a task sends one row
a bucket that it has met, which Spark adds up, and the driver gets ``BUCKETS`` rows. Documents of ``LEAST_WORDS`` words or
more are drawn without replacement by the Gumbel top-k: ranks are counted in ranges of scores, so no task orders them all.

Null and empty texts, and texts without a word, have no feature and weight 0. A null id takes part as the empty text in its
hash, and comes last among equal scores. Rows that repeat are documents of their own (ties by number of features and then in
any order, which changes no row's values). Very long texts are scanned whole, in one task each. Without documents the
result is empty; without target texts the gains are those of T = 0. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import column, kept, slices, stored, texts_of

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, PER_CENT = 20, 5
_SHORT = 64  # shifts by fewer bytes have a table of their own

# ----------------------------------------------------------------------------------------------------------------- CRC-32

_ONE_BYTE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)  # linear part of one byte's step


def _past_zero_byte(x: np.ndarray) -> np.ndarray:
    """The linear part of a CRC's step over one byte."""
    return _ONE_BYTE[x & np.uint32(255)] ^ (x >> np.uint32(8))


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map given by its values of each byte at each of four places."""
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Shifts by 0 to 63 bytes, and by 64 * 2**k bytes for k below 32; each as (4, 256)."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        now = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        short = []
        for _ in range(_SHORT):
            short.append(now)
            now = _past_zero_byte(now)
        long = [now]
        while len(long) < 32:
            long.append(_apply(long[-1], long[-1]))
        return np.array(short), np.array(long)

    return kept("crc shifts", make)


def shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What the CRCs of prefixes amount to ``by`` bytes later."""
    short, long = _tables()
    at = (by & (_SHORT - 1)) * 1024
    flat = short.reshape(-1)
    out = flat[at + (crc & 255)] ^ flat[at + 256 + ((crc >> 8) & 255)] ^ flat[at + 512 + ((crc >> 16) & 255)] ^ flat[at + 768 + (crc >> 24)]
    rest, k = by // _SHORT, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _apply(long[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


# --------------------------------------------------------------------------------------------------------------- features

# A-Z to a-z; all that is in no word to a space.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, and the document and bucket of each run of one to ``LONGEST`` words."""
    words, count = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
        count[i] = len(own)
        words += own
    n = len(words)
    if not n:
        return count, np.zeros(0, np.int64), np.zeros(0, np.int64)
    # One scan over " word word ...": the running CRC after each word. What a run starts from cancels, so texts go on from
    # each other.
    crc32 = zlib.crc32
    end = np.fromiter(accumulate([b" " + w for w in words], lambda crc, w: crc32(w, crc), initial=0), np.uint32, n + 1)
    begin = _past_zero_byte(end[:-1] ^ np.uint32(0xFFFFFFFF) ^ np.uint32(32)) ^ np.uint32(0xFFFFFFFF)  # past the space before the word
    end = end[1:]
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    start = np.r_[0, stop[:-1]] + 1
    doc = np.repeat(np.arange(len(texts)), count)
    docs, buckets = [], []
    for k in range(1, min(LONGEST, n) + 1):
        m = n - k + 1
        whole = doc[:m] == doc[k - 1 :]
        length = stop[k - 1 :] - start[:m]
        crc = end[k - 1 :] ^ shifted(begin[:m], length)
        docs.append(doc[:m][whole])
        buckets.append((crc[whole] % np.uint32(BUCKETS)).astype(np.int64))
    return count, np.concatenate(docs), np.concatenate(buckets)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in slices(batches):
        yield batch, *features(texts_of(batch))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all rows are in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, _, _, buckets in _features_of(batches):
            total += np.bincount(buckets, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the log of how much more frequent it is in the target (both smoothed by one), rounded down."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


# ------------------------------------------------------------------------------------------------------------------ plan


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, count, doc, buckets in _features_of(batches):
            n = np.bincount(doc, minlength=len(count))
            weight = np.zeros(len(count), np.int64)
            if len(doc):
                order = np.argsort(doc, kind="stable")
                used, first = np.unique(doc[order], return_index=True)
                weight[used] = np.add.reduceat(gain[buckets[order]], first)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(count), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def draw(weighted: DataFrame, salt: str = "42:") -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` of each row of ``weights``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(weighted.select("*", (F.col("weight") + gumbel).alias("score")), "scores")
    able = scored.where(F.col("n_words") >= LEAST_WORDS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    # Ranges of scores; a row's rank is its place in its range, after the rows of the ranges before it.
    ranged = able.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = stored(ranged.select("*", F.shiftright(place, 33).alias("part"), (place.bitwiseAND((1 << 33) - 1) + 1).alias("k")), "ranges")
    sizes = {r.part: r.n for r in placed.groupBy("part").agg(F.max("k").alias("n")).collect()}  # one row a range
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    drawn = PER_CENT * total // 100
    offsets = weighted.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + F.col("k")
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.join(F.broadcast(offsets), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < LEAST_WORDS).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and, of those drawn, ``rank`` of each of ``docs``; the texts of
    ``target`` are what the draw is to be like."""
    return draw(weights(docs, gains(bucket_counts(docs), bucket_counts(target))))
