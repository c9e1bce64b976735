"""Substring dedup by hashing of units: stretches of some words that the text itself bounds, and whole lines.

Words are runs of ASCII letters and digits, lower-cased, and characters beyond ASCII; marks and spaces don't count. A unit
begins at each word whose hash (with that of the next word) is the least among ``REACH`` words before and after it, and
after ``LONGEST`` words without one. So units have ``LEAST_UNIT`` words at least (smaller ones at the ends of a text are
passed over), five on average, and the same words give the same units wherever they stand, but for the units that a shared
stretch begins or ends in.

Digests of 128 bits are grouped over the whole table. The occurrence with the least id, and in it the first, is kept; all
others are repeats. Repeats that touch or overlap in a document make a passage, and passages of ``LEAST_WORDS`` words at
least are removed, with their original offsets (code points) retained. A shared stretch of 50 words holds such a passage;
what lies between its own ends and those of the units stays. A whole line that occurs again is a passage from
``LEAST_LINE`` words on; shorter lines that repeat are left alone by default, since many documents that are otherwise
their own share one.

Rows without id are left out. Null and empty texts have no unit. Rows that share an id are one document, whose equal
units count once. Of equal units of several documents the least id is kept. An empty table gives an empty result. Extra
columns are ignored. A task holds one whole text's words at a time (about 150 bytes a word).

Texts are read and hashed once, into a table of units. Digests are counted before their shuffle, so a line that a third of
all rows have is one row a task. Repeats meet what is kept of them in a join that leaves out units whose digest is
alone (a bit set of bounded size). Digests that ``HOT`` of all units have, of which there are at most 1 / ``HOT``, are
looked up where the units are, and their units are dealt evenly; so no key of the join has more than that share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factledger.llm.common import Words, bit_set, column, has_bit, mix, slices, stored, texts_of

LEAST_UNIT, LEAST_WORDS, LEAST_LINE = 3, 20, 15
REACH, LONGEST = 2, 16
HOT = 1e-4
MOST_BITS = 1 << 28  # of the set of repeated digests (32 MB)

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LINE = np.zeros(256, bool)
_LINE[10] = True

NAMES = ("d1", "d2", "doc", "word", "n_words", "start", "end", "again", "whole")
REST = ["doc_id", "word", "n_words", "start", "end", "again", "whole"]
UNIT_DDL = "d1 long, d2 long, doc_id long, word int, n_words int, start int, end int, again boolean, whole boolean"


def unit_starts(words: Words) -> np.ndarray:
    """Whether a unit begins at each word."""
    n = len(words.hash)
    value = mix(words.hash ^ (np.r_[words.hash[1:], np.uint64(0)] * np.uint64(0x9E3779B97F4A7C15)))
    if n:  # the last word of a text has no next one
        last = np.flatnonzero(np.r_[words.doc[1:] != words.doc[:-1], True])
        value[last] = mix(words.hash[last])
    least = np.ones(n, bool)
    for d in range(1, REACH + 1):
        apart = words.doc[d:] != words.doc[:-d]
        least[d:] &= apart | (value[d:] < value[:-d])
        least[:-d] &= apart | (value[:-d] <= value[d:])
    least |= np.r_[True, words.doc[1:] != words.doc[:-1]][:n]
    first = np.flatnonzero(least)
    size = np.diff(np.r_[first, n])
    rank = np.arange(n) - np.repeat(first, size)
    return least | (rank % LONGEST == 0) & (np.repeat(size, size) - rank >= LEAST_UNIT)


def line_starts(words: Words) -> np.ndarray:
    stops = np.r_[0, np.cumsum(_LINE[words.bytes])]
    return np.r_[True, (stops[words.start[1:]] != stops[words.end[:-1]]) | (words.doc[1:] != words.doc[:-1])][: len(words.hash)]


def units(texts: list[str], least_line: int = LEAST_LINE) -> dict[str, np.ndarray]:
    """The units and lines of the texts. ``again`` marks those that have stood in the same text before."""
    words = Words(texts, _GAP)
    point = np.r_[0, np.cumsum((words.bytes & 0xC0) != 0x80)]
    parts = []
    for whole, starts, least in ((False, unit_starts(words), LEAST_UNIT), (True, line_starts(words), least_line)):
        first = np.flatnonzero(starts)
        size = np.diff(np.r_[first, len(words.hash)])
        rank = np.arange(len(words.hash)) - np.repeat(first, size)
        digest = [mix(np.add.reduceat(mix(words.hash + rank.astype(np.uint64) * np.uint64(lane)), first) + np.uint64(whole)) if len(first) else np.zeros(0, np.uint64) for lane in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
        keep = size >= least
        first, size, d1, d2 = first[keep], size[keep], digest[0][keep], digest[1][keep]
        doc = words.doc[first]
        order = np.lexsort((first, d2, d1, doc))
        again = np.zeros(len(first), bool)
        a, b = order[:-1], order[1:]
        again[b[(doc[a] == doc[b]) & (d1[a] == d1[b]) & (d2[a] == d2[b])]] = True
        zero = point[words.doc_start[doc]]
        parts.append((d1, d2, doc, first - words.first[doc], size, point[words.start[first]] - zero, point[words.end[first + size - 1]] - zero, again, np.full(len(first), whole)))
    return dict(zip(NAMES, map(np.concatenate, zip(*parts, strict=True)), strict=True))


def unit_table(docs: DataFrame, least_line: int = LEAST_LINE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            u = units(texts_of(batch), least_line)
            digest = [pa.array(u[x].view(np.int64)) for x in ("d1", "d2")]
            places = [pa.array(u[x].astype(np.int32)) for x in ("word", "n_words", "start", "end")]
            yield pa.RecordBatch.from_arrays([*digest, column(batch, "doc_id").take(pa.array(u["doc"])), *places, pa.array(u["again"]), pa.array(u["whole"])], [x.split()[0] for x in UNIT_DDL.split(", ")])

    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, UNIT_DDL)


def repeated_units(docs: DataFrame, least_line: int = LEAST_LINE, hot: float = HOT) -> DataFrame:
    """The units and lines whose words are kept elsewhere, with ``kept_doc_id``."""
    unit = stored(unit_table(docs, least_line), "units")
    kept = stored(unit.groupBy("d1", "d2").agg(F.min("doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "kept")
    common = kept.where(F.col("n") >= max(2.0, hot * unit.count())).select("d1", "d2", "kept_doc_id").toArrow()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast({(a, b): k for a, b, k in zip(*(common.column(x).to_pylist() for x in ("d1", "d2", "kept_doc_id")), strict=True)})
    bits = sc.broadcast(bit_set(kept.select(F.col("d1").alias("h")), MOST_BITS))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves out digests that stand alone; gives hot ones what is kept of them, and a key that no other row has."""
        first = np.array(sorted({a for a, _ in shared.value}), np.int64)
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(bits.value, column(batch, "d1").to_numpy().view(np.uint64))))
            d1, d2, doc = (column(batch, x).to_numpy().copy() for x in ("d1", "d2", "doc_id"))
            found = [None] * len(d1)
            for i in np.flatnonzero(np.isin(d1, first)).tolist():
                if (known := shared.value.get((int(d1[i]), int(d2[i])))) is not None:
                    found[i] = known
                    d1[i], d2[i] = doc[i], -1 - i
            yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), *[column(batch, x) for x in REST], pa.array(found, pa.int64())], ["d1", "d2", *REST, "hot_id"])

    met = unit.mapInArrow(mark, UNIT_DDL + ", hot_id long").join(kept.drop("n"), ["d1", "d2"], "left").withColumn("kept_doc_id", F.coalesce("hot_id", "kept_doc_id"))
    return met.where("again or doc_id > kept_doc_id").where("kept_doc_id is not null").select("doc_id", "word", "n_words", "start", "end", "whole", "kept_doc_id")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE, hot: float = HOT) -> DataFrame:
    """``doc_id``, ``start``, ``end``, ``n_words``, ``n_units`` of each passage to remove, and ``kept_doc_id`` (least) and
    ``kept_doc_ids``: where its words are kept."""
    by_doc = repeated_units(docs, least_line, hot).repartition("doc_id")
    once = by_doc.groupBy("doc_id", "word", "n_words", "start", "end", "whole").agg(F.min("kept_doc_id").alias("kept_doc_id")).withColumn("stop", F.col("word") + F.col("n_words"))
    by_place = Window.partitionBy("doc_id").orderBy("word", "stop")
    so_far = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    return (
        once.withColumn("apart", F.when(F.col("word") <= so_far, 0).otherwise(1))
        .withColumn("passage", F.sum("apart").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "passage")
        .agg(
            F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("stop") - F.min("word")).cast("long").alias("n_words"), F.count_if(~F.col("whole")).alias("n_units"),
            F.array_sort(F.collect_set("kept_doc_id")).alias("kept_doc_ids"), F.max("whole").alias("whole"),
        )
        .where(F.col("whole") | (F.col("n_words") >= least_words))
        .select("doc_id", "start", "end", "n_words", "n_units", F.col("kept_doc_ids")[0].alias("kept_doc_id"), "kept_doc_ids")
    )


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with the passages cut out of ``text``, and ``removed``: their original offsets. Rows without id or
    text stay as they are."""
    cuts = repeated_passages(docs, least_words).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    both = docs.drop("removed").join(cuts, "doc_id", "left")
    # What is left: the stretches before, between and after the cuts.
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda x: x["end"]))
    stops = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.char_length("text").cast("long")))
    rest = F.array_join(F.zip_with(edges, stops, lambda a, b: F.col("text").substr((a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))), "")
    return both.withColumn("text", F.when(F.col("removed").isNull() | F.col("text").isNull(), F.col("text")).otherwise(rest))
