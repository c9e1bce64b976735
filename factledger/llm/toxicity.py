"""Toxicity as severity grades, by cumulative-link (proportional odds) regression on sparse text features.

P(grade > k) = sigmoid(w.x - t_k): the weights are shared by all thresholds, and the thresholds are kept in order. The
expected severity is the sum over k of P(grade > k).

Labels say only whether a document is toxic, so the grades of the training rows are made here: 0 for those that are not;
for the others 1, 2 or 3 by thirds of how many of their words are markers (terms much more frequent in toxic rows). The
fit uses at most about ``TOXIC`` toxic and ``OTHER`` other labelled rows, by a hash of their ids; the model has at most
``FEATURES`` terms. Every document is then scored by its whole text.

A feature is ln(1 + occurrences) of a term: a run of ASCII letters and digits, lower-cased, and characters beyond ASCII.
Null and empty texts, and texts without a term of the model, get what the thresholds alone say. With labels of one class
or none, every score is that share. Repeated rows and ids, null ids and extra columns don't matter to scoring; of labels
that contradict each other for an id, the highest counts; of rows that share a labelled id, the one with the fewest words
is learnt from. An empty table gives an empty result. A text on the decision value is toxic. A task holds one whole text's
words at a time (about 100 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import Words, column, slices, texts_of

#: A document is called toxic if P(grade > 0) is at least the value that this share of the clean training rows stays under,
#: each scored by a model of the other ``FOLDS`` - 1 parts of them, and one more row at the upper limit; between the limits.
CLEAN_SHARE, DECISION_LIMITS, FOLDS = 0.998, (0.1, 0.5), 3
TOXIC, OTHER, FEATURES, LEAST_DF, LEAST_Z = 6000, 9000, 4000, 3, 2.0
GRADES = 4
RIDGE, STEPS, RATE = 0.3, 400, 0.05  # the ridge is divided by the number of rows

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of each distinct pair, and the number of words of each text."""
    words = Words(texts, _GAP)
    order = np.lexsort((words.hash, words.doc))
    term, doc = words.hash[order], words.doc[order]
    at = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else np.zeros(0, np.int64)
    return doc[at], term[at], np.diff(np.r_[at, len(term)]), np.diff(words.first)


@dataclass
class Counts:
    """The terms of some texts: document, term and occurrences of each distinct pair, and the words of each text."""

    doc: np.ndarray
    term: np.ndarray
    times: np.ndarray
    words: np.ndarray

    def where(self, mask: np.ndarray) -> Counts:
        keep = mask[self.doc]
        return Counts((np.cumsum(mask) - 1)[self.doc[keep]], self.term[keep], self.times[keep], self.words[mask])


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending
    decision: float = DECISION_LIMITS[1]

    def above(self, x: Counts) -> np.ndarray:
        """(texts, thresholds): P(grade > k)."""
        score = np.zeros(len(x.words))
        if len(self.terms) and len(x.term):
            at = np.minimum(np.searchsorted(self.terms, x.term), len(self.terms) - 1)
            hit = self.terms[at] == x.term
            score += np.bincount(x.doc[hit], np.log1p(x.times[hit]) * self.weights[at[hit]], len(x.words))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -50, 50)))


def ordinal_fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean negative log-likelihood with a ridge. Thresholds are t_0 and t_0 plus
    sums of exponentials, so they stay in order."""
    n, k = len(grades), GRADES - 1
    weights, free = np.zeros(n_terms), np.r_[1.0, np.full(k - 1, -0.5)]
    moment = [np.zeros(n_terms + k), np.zeros(n_terms + k)]
    for step in range(1, STEPS + 1):
        t = free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]
        score = np.bincount(rows, values * weights[cols], n)
        cdf = np.c_[np.zeros(n), 1 / (1 + np.exp(np.clip(score[:, None] - t[None, :], -50, 50))), np.ones(n)]  # P(grade <= j - 1)
        slope = cdf * (1 - cdf)
        own = np.arange(n)
        p = np.maximum(cdf[own, grades + 1] - cdf[own, grades], 1e-12)
        d_score = (slope[own, grades + 1] - slope[own, grades]) / p  # of the loss
        d_t = np.zeros(k + 2)
        np.add.at(d_t, grades + 1, -slope[own, grades + 1] / p)
        np.add.at(d_t, grades, slope[own, grades] / p)
        d_t = d_t[1:-1] / n
        d_free = np.r_[d_t.sum(), [np.exp(free[j]) * d_t[j:].sum() for j in range(1, k)]]
        grad = np.r_[np.bincount(cols, values * d_score[rows], n_terms) / n + RIDGE / n * weights, d_free]
        moment[0] = 0.9 * moment[0] + 0.1 * grad
        moment[1] = 0.999 * moment[1] + 0.001 * grad * grad
        move = RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.999**step)) + 1e-8)
        weights -= move[:n_terms]
        free -= move[n_terms:]
    return weights, free[0] + np.r_[0.0, np.cumsum(np.exp(free[1:]))]


def learn(x: Counts, toxic: np.ndarray) -> Model:
    """A model of labelled texts; ``toxic`` is 0 or 1."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        t = np.log((1 - share + 1e-6) / (share + 1e-6))
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, t))
    doc, times = x.doc, x.times
    terms, at = np.unique(x.term, return_inverse=True)
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    a = np.bincount(at, toxic[doc], len(terms))
    b = np.bincount(at, minlength=len(terms)) - a
    # Signed root of the chi-square statistic of presence against toxicity.
    rate = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / n0))
    z[(a + b < LEAST_DF) | (np.abs(z) < LEAST_Z)] = 0
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] != 0]
    marker = (z > 4) & (np.log((a + 0.5) / n1) - np.log((b + 0.5) / n0) > 2)
    hits = np.bincount(doc, times * marker[at], len(toxic)) / np.maximum(1, x.words)
    cuts = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    place = np.full(len(terms), -1)
    place[chosen] = np.arange(len(chosen))
    use = place[at] >= 0
    weights, thresholds = ordinal_fit(doc[use], place[at[use]], np.log1p(times[use]), grades, len(chosen))
    return Model(terms[chosen], weights, thresholds)


def decided(x: Counts, toxic: np.ndarray, shift: float) -> float:
    """The least P(grade > 0) of a document that is called toxic, by cross-fitting over all clean training rows."""
    seen = []
    for fold in range(FOLDS):
        kept = np.arange(len(toxic)) % FOLDS == fold
        part = learn(x.where(~kept), toxic[~kept])
        part.thresholds = part.thresholds + shift
        seen.append(part.above(x.where(kept & (toxic == 0)))[:, 0])
    # One row more is taken to stand at the upper limit, so that few rows give a careful value.
    p = np.concatenate([*seen, [DECISION_LIMITS[1]]])
    return float(np.clip(np.quantile(p, CLEAN_SHARE), *DECISION_LIMITS))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        doc, term, times, words = term_counts(texts_of(batch))
        edge = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edge, pa.array(v)) for v in (term.view(np.int64), times.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "label"), pa.array(words.astype(np.int32)), *lists], ["doc_id", "label", "words", "terms", "times"])


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, other: int = OTHER) -> Model:
    """``labels`` has ``doc_id`` and ``toxic``. The ids of the bounded sample are broadcast; texts are not shuffled."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    limit = F.when(F.col("label") == 1, int(min(1, toxic / max(1, counts.get(1, 0))) * (1 << 30))).otherwise(int(min(1, other / max(1, counts.get(0, 0))) * (1 << 30)))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= limit)
    # Terms are counted where the texts are; the driver gets the counts of the bounded sample.
    # The limits bound the ids of the sample, and so what is broadcast, and each id counts once however many rows have it.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    counted = found.mapInArrow(_counted, "doc_id long, label int, words int, terms array<bigint>, times array<int>")
    once = counted.groupBy("doc_id").agg(F.min(F.struct("words", "terms", "times", "label")).alias("x"))
    rows = once.orderBy("doc_id").select("x.*").toArrow().combine_chunks()
    label = rows.column("label").to_numpy().astype(np.int64)
    terms, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
    sizes = np.asarray(terms.value_lengths()) if len(label) else np.zeros(0, np.int64)
    x = Counts(np.repeat(np.arange(len(label), dtype=np.int32), sizes), terms.flatten().to_numpy().view(np.uint64), times.flatten().to_numpy(), rows.column("words").to_numpy())
    model = learn(x, label)
    # Toxic rows may be sampled at another rate than the rest; the thresholds are moved to the odds of all labels.
    rate = [min(1, limit / max(1, counts.get(label, 0))) for label, limit in ((1, toxic), (0, other))]
    shift = float(np.log(rate[0] / rate[1]))
    return Model(model.terms, model.weights, model.thresholds + shift, decided(x, label, shift))


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``expected_severity``, ``grade`` (the most likely), ``p_toxic`` (P(grade > 0)) and ``toxic``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = shared.value.above(Counts(*term_counts(texts_of(batch))))
            each = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= shared.value.decision)],
                ["doc_id", "expected_severity", "grade", "p_toxic", "toxic"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean")
