"""I-Match fingerprints: the distinct terms of a text whose inverse document frequency is in a band are sorted and hashed,
once with the whole lexicon and once with each of several randomised parts of it (Chowdhury et al., 2002; Kolcz et al.,
2004).

Document frequencies cover every text: each task counts the terms of a stretch of the table before the shuffle. The
band is given as shares of the documents, so the lexicon has at most 1 / RAREST times the mean number of distinct terms
of a text, whatever the size of the corpus; that is what is broadcast.

A fingerprint is the list of its hashes, as hex, joined by ``-``; a part of the lexicon that no term is in gives ``0``.
A text with none of the lexicon's terms is fingerprinted by all its terms (and by its bytes if it has no term), marked
by a leading ``x``. Equal texts have equal fingerprints. Null texts count as empty. The likeness of two fingerprints is
the share of parts with equal hashes among those that either has terms in, 0 to 1; fingerprints of which one is marked
are alike (1) only if equal.

Documents are in order of id and then text; rows without id have no place in it and are left out there. Repeated rows
are separate documents. Extra columns are ignored. An empty table gives an empty result. Ties of a cut between ranges of
ids stay in one range. A task holds one whole text and the one after it at a time (about 100 bytes a word).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import Words, column, flat, mix, slices, texts_of

RAREST, COMMONEST = 1e-3, 0.3  # shares of the documents between which a term is in the lexicon
#: Each part keeps a term with one of these chances. Sparse parts still agree when much of a text differs.
PARTS = (1 / 2,) * 4 + (1 / 8,) * 8 + (1 / 32,) * 12
STRETCH = 4_000_000  # words that a task counts before it passes the counts on

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's terms: runs of ASCII letters and digits, lower-cased, and characters beyond."""
    words = Words(texts, _GAP)
    order = np.lexsort((words.hash, words.doc))
    value, doc = words.hash[order], words.doc[order]
    keep = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])] if len(value) else np.zeros(0, bool)
    value, doc = value[keep], doc[keep]
    return np.split(value, np.searchsorted(doc, np.arange(1, len(texts)))) if len(texts) else []


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> np.ndarray:
    """Sorted hashes of the terms in the band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = texts = 0

        def counted() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times.astype(np.int64))], ["term", "n"])

        for batch in slices(batches):
            held.append(flat(terms(texts_of(batch)))[0])
            size, texts = size + len(held[-1]), texts + batch.num_rows
            if size >= STRETCH:
                yield counted()
                held, size = [], 0
        yield counted()

    n = docs.count()
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    rows = found.where((F.col("n") >= rarest * n) & (F.col("n") > 1) & (F.col("n") <= commonest * n)).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def membership(lexicon: np.ndarray) -> np.ndarray:
    """(terms, parts): whether a term of the lexicon is in each part. A coin of the term and the part's number decides."""
    out = np.empty((len(lexicon), len(PARTS)), bool)
    for k, chance in enumerate(PARTS):
        out[:, k] = (mix(lexicon + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(11)) < np.uint64(int(chance * 2**53))
    return out


def fingerprints(texts: list[str], lexicon: np.ndarray, member: np.ndarray) -> list[str]:
    sets = terms(texts)
    value, sizes = flat(sets)
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.minimum(np.searchsorted(lexicon, value), max(0, len(lexicon) - 1))
    known = lexicon[at] == value if len(lexicon) else np.zeros(len(value), bool)
    at, doc = at[known], doc[known]
    has = np.bincount(doc, minlength=len(texts)) > 0
    lines: list[list[str]] = [[] for _ in texts]
    place = np.arange(len(at)) - np.searchsorted(doc, doc)
    for k in range(-1, len(PARTS)):
        chosen = np.ones(len(at), bool) if k < 0 else member[at, k]
        # The hash of a sorted list of terms: each term is mixed with its rank, and the sum is mixed again.
        d = doc[chosen]
        rank = place[chosen] if k < 0 else np.arange(len(d)) - np.searchsorted(d, d)
        part = mix(lexicon[at[chosen]] + rank.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) if len(d) else np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
        total = np.zeros(len(texts), np.uint64)
        if len(d):
            total[d[edge]] = mix(np.add.reduceat(part, edge) ^ np.uint64(k + 2)) | np.uint64(1)
        for i, x in enumerate(total.tolist()):
            if has[i]:
                lines[i].append(f"{x:x}")
    out = []
    for i, text in enumerate(texts):
        if has[i]:
            out.append("-".join(lines[i]))
        else:
            raw = sets[i].tobytes() if len(sets[i]) else text.encode("utf-8", "surrogatepass")
            out.append("x" + hashlib.blake2b(raw, digest_size=8).hexdigest())
    return out


def likeness(a: str, b: str) -> float:
    if a[0] == "x" or b[0] == "x":
        return float(a == b)
    same = total = 0
    for x, y in zip(a.split("-")[1:], b.split("-")[1:], strict=True):
        if x != "0" or y != "0":
            total += 1
            same += x == y
    return same / total if total else float(a == b)


def fingerprint(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row, without order or shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, membership(lexicon)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fingerprints(texts_of(batch), *shared.value))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


# ------------------------------------------------------------------------------------- texts beside their next neighbour


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _rank(bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the id: found among every w-th bound, then among the w that follow."""
    w = max(1, int(len(bounds) ** 0.5))
    limits = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[k : k + w]]) for k in range(0, len(bounds), w)])
    coarse = F.size(F.filter(limits, lambda x: x[0] <= F.col("doc_id")))
    return (coarse - 1) * w + F.size(F.filter(F.element_at(limits, coarse), lambda x: x <= F.col("doc_id")))


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of ids and sorted, each range followed by a copy of the rows that begin the next one.

    Columns ``part``, ``copy``, ``doc_id``, ``text``. One shuffle of the texts. The bounds are ids that occur, found by
    approximate quantiles, so that each range knows what begins the next; the last is followed by the first."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = ids.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [k / parts for k in range(parts)]).alias("cuts")).first()
    if seen.least is None:
        return ids.select(F.lit(1).alias("part"), F.lit(0).alias("copy"), "doc_id", "text")
    bounds = sorted({seen.least, *seen.cuts})
    own = F.struct(F.col("rank").alias("part"), F.lit(0).alias("copy"))
    before = F.struct(F.when(F.col("rank") == 1, F.lit(len(bounds))).otherwise(F.col("rank") - 1).alias("part"), F.lit(1).alias("copy"))
    places = F.when(F.col("doc_id").isin(bounds), F.array(own, before)).otherwise(F.array(own))
    dealt = ids.withColumn("rank", _rank(bounds)).select(F.explode(places).alias("x"), "doc_id", "text").select("x.part", "x.copy", "doc_id", "text")
    # A task for each range, so that none gets several.
    return dealt.repartitionById(len(bounds), (F.col("part") - 1).cast("int")).sortWithinPartitions("part", "copy", "doc_id", "text")


def fingerprint_with_next(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next`` of each document: beside the text with its second half exchanged, and beside the next document."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, membership(lexicon)))
    dealt = neighbours(docs)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, copy, id, text, fingerprint of the row whose next one is not known yet
        for batch in slices(batches):
            texts = texts_of(batch)
            rows = list(zip(column(batch, "part").to_pylist(), column(batch, "copy").to_pylist(), column(batch, "doc_id").to_pylist(), texts, fingerprints(texts, *shared.value), strict=True))
            rows = [last, *rows] if last else rows
            last = rows[-1]
            # A copy ends its range: only the first of them is a next one, and none has a next one here.
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            if not pairs:
                continue
            changed = [edited(x[3], y[3]) for x, y in pairs]
            marks = fingerprints(changed, *shared.value)
            out = [
                (x[2], len(x[3]), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), x[4], m, likeness(x[4], m), likeness(x[4], y[4]))
                for (x, y), c, m in zip(pairs, changed, marks, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
