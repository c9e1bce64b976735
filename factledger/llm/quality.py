"""Quality by co-training (Blum and Mitchell, 1998): one classifier sees a page's text, the other its metadata. Over
rounds each labels the documents that it is most sure of, and the other one learns from those labels. At the end each
view is calibrated on labelled rows kept back, the calibrated views are combined, and every document is scored.

A view learns from about ``LABELLED`` labelled rows, by a hash of their ids, less a fifth that is kept back, and from about
``PSEUDO`` of those that the other view is sure of, by a hash of the whole row (a row that repeats counts once). The pool that a view labels are all other documents:
in round r it is sure of the documents beyond the quantiles that cut off r times ``TAKEN`` of all of them, split
between the classes as the labels are, and on the right side of one half. Features are hashed to a fixed number and stored
once; the rounds read them, so the driver only gets quantiles, counts and the features of the bounded samples.

Text view: distinct terms, and binned shares of marks, digits, capitals, bars, repeated lines and words, and length of
words. Metadata view: source, language, and size. Null values are categories of their own; null texts count as empty.
With labels of one class or none every score is that share (one half for none). An empty table gives an empty result.
Ties go with the quantile that they equal. Repeated rows and ids, null ids and extra columns don't matter to scoring; of
labels that contradict each other for an id, the lowest counts, and of rows that share a labelled id one. A task holds one
whole text's words at a time (about 100 bytes a word).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import SLOTS, Words, column, discard, mark_of, mix, slices, slot, stored, texts_of

LABELLED, PSEUDO = 5000, 2000
BUCKETS = 1 << 15
ROUNDS, TAKEN = 4, 0.05
STEPS, RATE, RIDGE = 120, 0.05, 3e-4
VIEWS = ("text", "meta")

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _bucket(names: np.ndarray) -> np.ndarray:
    return (mix(names.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def _named(parts: list[str]) -> np.ndarray:
    return _bucket(Words([p.replace(" ", "_") or "_" for p in parts]).hash)


MARKS = 10  # binned features of a text


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (sorted), columns, values. The last ``MARKS`` of each row are the binned ones."""
    words = Words(texts, _GAP)
    order = np.lexsort((words.hash, words.doc))
    term, doc = words.hash[order], words.doc[order]
    keep = np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])] if len(term) else np.zeros(0, bool)
    term, doc = term[keep], doc[keep]
    distinct = np.bincount(doc, minlength=len(texts))
    count, named = np.diff(words.first), []
    for i, text in enumerate(texts):
        n, lines = max(1, len(text)), [x for x in text.split("\n") if x]
        letters = sum(map(text.count, "\"#$%&*+/<=>@[]^_{}~"))
        capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        shares = {
            "marks": letters / n, "bars": text.count("|") / n, "ends": sum(map(text.count, ".!?")) / n, "digits": sum(map(text.count, "0123456789")) / n, "capitals": capitals / n,
            "bangs": text.count("!") / n, "lines": 1 - len(set(lines)) / max(1, len(lines)), "words": 1 - distinct[i] / max(1, count[i]), "spaces": text.count(" ") / n,
        }
        named += [f"{k}:{int(np.log2(v * 1000 + 1) * 2)}" for k, v in shares.items()] + [f"size:{int(np.log2(count[i] + 1))}"]
    rows = np.concatenate([doc, np.repeat(np.arange(len(texts)), MARKS)])
    cols = np.concatenate([_bucket(term), _named(named) if named else np.zeros(0, np.int64)])
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    return rows, cols, text_values(distinct + MARKS)


def text_values(sizes: np.ndarray) -> np.ndarray:
    """The values of texts with so many features: terms by the root of their number, marks one half."""
    value = np.repeat(1 / np.sqrt(np.maximum(1, sizes - MARKS)), sizes)
    stop = np.cumsum(sizes)
    value[(stop[:, None] - 1 - np.arange(MARKS)).ravel()] = 0.5
    return value


def meta_features(source: list, lang: list, size: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = []
    for s, g, n in zip(source, lang, size, strict=True):
        level = "none" if n is None else int(np.log2(max(0, n) + 1) * 2)
        names += [f"source:{s}", f"lang:{g}", f"size:{level}", f"both:{g}/{level}"]
    rows = np.repeat(np.arange(len(source)), 4)
    return rows, _named(names) if names else np.zeros(0, np.int64), np.ones(len(names))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


Features = tuple[np.ndarray, np.ndarray, np.ndarray]  # rows (sorted), columns, values


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, x: Features, n: int) -> np.ndarray:
        rows, cols, values = x
        return np.bincount(rows, values * self.weights[cols], n) + self.bias


def logistic(x: Features, y: np.ndarray, size: int = BUCKETS, ridge: float = RIDGE) -> Linear:
    """Logistic regression by Adam, over the columns that occur. Each row has a feature."""
    rows, cols, values = x
    n = len(y)
    own, at = np.unique(cols, return_inverse=True)
    begin = np.searchsorted(rows, np.arange(n))
    by_column = np.argsort(at, kind="stable")
    first = np.searchsorted(at[by_column], np.arange(len(own)))
    row_of, value_of = rows[by_column], values[by_column]
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    w = np.r_[np.zeros(len(own)), np.log(share / (1 - share))]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1 if n else 1):
        error = (_sigmoid(np.add.reduceat(values * w[at], begin) + w[-1]) - y) / n
        grad = np.r_[np.add.reduceat(value_of * error[row_of], first) + ridge * w[:-1], error.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[own] = w[:-1]
    return Linear(weights, float(w[-1]))


@dataclass
class Model:
    views: list[Linear]  # text, metadata
    scale: list[tuple[float, float]]  # calibration of each view's logit
    mix: tuple[float, float, float]  # bias and the weight of each calibrated logit

    def score(self, x: list, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        each = [a * v.logit(f, n) + b for v, f, (a, b) in zip(self.views, x, self.scale, strict=True)]
        return _sigmoid(self.mix[0] + self.mix[1] * each[0] + self.mix[2] * each[1]), [_sigmoid(e) for e in each]


def _dense(columns: list[np.ndarray]) -> Features:
    n = len(columns[0])
    return np.repeat(np.arange(n), len(columns)), np.tile(np.arange(len(columns)), n), np.stack(columns, axis=1).ravel()


@dataclass
class Sample:
    """Features of both views of some rows."""

    text: list[np.ndarray]  # columns of each row
    meta: list[np.ndarray]

    def views(self, keep: np.ndarray | None = None) -> list[Features]:
        at = np.arange(len(self.text)) if keep is None else np.flatnonzero(keep)
        out = []
        for name in VIEWS:
            own = [getattr(self, name)[i] for i in at.tolist()]
            sizes = np.array([len(x) for x in own], np.int64)
            values = text_values(sizes) if name == "text" else np.ones(int(sizes.sum()))
            out.append((np.repeat(np.arange(len(own)), sizes), np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64), values))
        return out

    def __add__(self, other: Sample) -> Sample:
        return Sample(self.text + other.text, self.meta + other.meta)


def co_train(x: Sample, label: np.ndarray, pool: Callable, rounds: int = ROUNDS) -> Model:
    """``x``, ``label`` (0 or 1): labelled rows, of which a fifth is kept back to calibrate. ``pool(models, share, r)`` gives
    for each view the rows that it is sure of in round r, and what it calls them."""
    share = float(label.mean()) if len(label) else 0.5
    if share in (0.0, 1.0) or not len(label):
        bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Model([Linear(np.zeros(BUCKETS), bias)] * 2, [(1.0, 0.0)] * 2, (0.0, 0.5, 0.5))
    held = np.arange(len(label)) % 5 == 0
    own = Sample([x.text[i] for i in np.flatnonzero(~held)], [x.meta[i] for i in np.flatnonzero(~held)])
    models = [logistic(f, label[~held].astype(float)) for f in own.views()]
    for r in range(1, rounds + 1):
        sure = pool(models, share, r)
        # Each view learns from what the other one is sure of.
        models = [logistic((own + sure[1 - k][0]).views()[k], np.r_[label[~held], sure[1 - k][1]].astype(float)) for k in range(len(VIEWS))]
    y, back = label[held].astype(float), x.views(held)
    scale, each = [], []
    for f, model in zip(back, models, strict=True):
        z = model.logit(f, len(y))
        fitted = logistic(_dense([z]), y, 1, 1e-3)
        scale.append((float(fitted.weights[0]), fitted.bias))
        each.append(scale[-1][0] * z + scale[-1][1])
    both = logistic(_dense(each), y, 2, 1e-3)
    return Model(models, scale, (both.bias, float(both.weights[0]), float(both.weights[1])))


def _views(batch: pa.RecordBatch) -> list[Features]:
    return [text_features(texts_of(batch)), meta_features(*[column(batch, x).to_pylist() for x in ("source", "lang", "n_chars")])]


FEATURE_DDL = "doc_id long, mark long, text array<int>, meta array<int>"


ROW = ("doc_id", "mark")


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = []
        for rows, cols, _ in _views(batch):
            edge = pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists.append(pa.ListArray.from_arrays(edge, pa.array(cols.astype(np.int32))))
        yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in ROW], *lists], [*ROW, *VIEWS])


def _logits(batch: pa.RecordBatch, models: list[Linear]) -> list[np.ndarray]:
    out = []
    for name, model in zip(VIEWS, models, strict=True):
        lists = column(batch, name)
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        rows, cols = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy()
        out.append(model.logit((rows, cols, text_values(sizes) if name == "text" else np.ones(len(cols))), len(sizes)))
    return out


def _gathered(rows: DataFrame) -> pa.Table:
    """Bounded rows with ``doc_id``, ``label`` and features on the driver, in an order that hangs on them alone."""
    return rows.orderBy("doc_id", "label", F.xxhash64("text", "meta")).toArrow().combine_chunks()


def _sample(rows: pa.Table) -> tuple[Sample, np.ndarray]:
    text, meta = ([np.array(x, np.int64) for x in rows.column(v).to_pylist()] for v in VIEWS)
    return Sample(text, meta), rows.column("label").to_numpy().astype(np.int64)


def _spark_pool(features: DataFrame, labelled, seed_rows: int) -> Callable:
    """The documents of ``features`` whose id is not in the broadcast array ``labelled``."""
    spark = features.sparkSession

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.invert(pc.is_in(column(batch, "doc_id"), value_set=pa.array(labelled.value[0], pa.int64()), skip_nulls=True)))

    def pool(models: list[Linear], share: float, r: int) -> list[tuple[Sample, np.ndarray]]:
        shared = spark.sparkContext.broadcast(models)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in outside(batches):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in _logits(batch, shared.value)], list(VIEWS))

        taken = min(0.5, r * TAKEN)
        logits = stored(features.mapInArrow(scored, "text double, meta double"), "logits")
        cuts = logits.agg(*[F.percentile_approx(v, [taken * (1 - share), 1 - taken * share], 10000).alias(v) for v in VIEWS]).first()
        if cuts.text is None:
            return [(Sample([], []), np.zeros(0, np.int64))] * len(VIEWS)
        is_low = {v: f"{v} <= {cuts[v][0]!r}D and {v} < 0" for v in VIEWS}
        is_high = {v: f"{v} >= {cuts[v][1]!r}D and {v} > 0" for v in VIEWS}
        counts = logits.agg(*[F.count_if(F.expr(f"({is_low[v]}) or ({is_high[v]})")).alias(v) for v in VIEWS]).first()
        discard(logits)
        out = []
        for k, name in enumerate(VIEWS):
            rate = int(min(1.0, seed_rows / max(1, counts[name])) * SLOTS)

            def sure(batches: Iterator[pa.RecordBatch], k: int = k, name: str = name) -> Iterator[pa.RecordBatch]:
                for batch in outside(batches):
                    z = _logits(batch, shared.value)[k]
                    low, high = (z <= cuts[name][0]) & (z < 0), (z >= cuts[name][1]) & (z > 0)
                    keep = pa.array(low | high)
                    yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in (*ROW, *VIEWS)], pa.array(high.astype(np.int32))], [*ROW, *VIEWS, "label"]).filter(keep)

            # By a hash of the whole row, and rows that repeat once: neither rows without id nor copies come together.
            part = features.where(slot(F.col("mark"), 10 * r + k) < rate).mapInArrow(sure, FEATURE_DDL + ", label int")
            once = part.groupBy("mark").agg(F.first(F.struct("doc_id", *VIEWS, "label")).alias("x")).select("x.*")
            out.append(_sample(_gathered(once)))
        return out

    return pool


COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> Model:
    """``labels`` has ``doc_id`` and ``quality``; ``docs`` the columns ``COLUMNS``."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("label"))
    limit = int(min(1, labelled / max(1, known.count())) * SLOTS)
    chosen = known.where(slot(F.col("doc_id")) < limit)  # ids are distinct and not null here.select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    label_of = {r.doc_id: r.label for r in chosen.collect()}  # about ``labelled`` rows
    ids = np.array(sorted(label_of), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((ids, np.array([label_of[i] for i in ids.tolist()], np.int32)))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:], mark_of(COLUMNS).alias("mark"))
    features = stored(marked.mapInArrow(_featured, FEATURE_DDL), "features")

    def with_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = shared.value
            label = pa.array(labels).take(pc.index_in(column(batch, "doc_id"), value_set=pa.array(ids, pa.int64()), skip_nulls=True))
            yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in (*ROW, *VIEWS)], label], [*ROW, *VIEWS, "label"]).filter(label.is_valid())

    # A labelled id that several rows have counts once.
    own = features.mapInArrow(with_label, FEATURE_DDL + ", label int").groupBy("doc_id").agg(F.min(F.struct("text", "meta", "label")).alias("x")).select("doc_id", "x.*")
    x, label = _sample(_gathered(own))
    return co_train(x, label, _spark_pool(features, shared, pseudo), rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``quality`` (0 to 1), ``p_text``, ``p_meta`` and ``keep`` (quality of one half at least)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p, (text, meta) = shared.value.score(_views(batch), batch.num_rows)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(p), pa.array(text), pa.array(meta), pa.array(p >= 0.5)], ["doc_id", "quality", "p_text", "p_meta", "keep"])

    return docs.select(*COLUMNS).mapInArrow(run, "doc_id long, quality double, p_text double, p_meta double, keep boolean")
