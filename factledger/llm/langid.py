"""Language identification: script ranges narrow the candidate languages of each word, words are scored by character
n-grams, and Viterbi over the words of a text, with a penalty for each switch, labels spans of mixed-language text.

Training counts hashed character n-grams (1 to 4 letters, with word edges) over about ``MAX_TRAIN`` distinct texts of each
language (drawn by a hash of the text, so neither rows without id nor repeated rows come together), and learns the ``LANGUAGES`` languages that most rows have; the model has a fixed size of 4 x BUCKETS scores a
language (0.5 MB). Everything else covers all rows.

Null texts and texts without a letter get ``und``, score 0 and no span. Ties go to the language that is first in
alphabetical order. With no labelled row, and so with an empty table, every text is ``und``. Repeated rows give repeated
results. A task holds one whole text at a time (some 100 bytes a character and what ``LANGUAGES`` scores a word take).
Rows and columns beyond id and text play no part in a prediction; ``names`` gives the results other names where columns
that are kept have theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import SLOTS, column, drawn, kept, quoted, slices, texts_of

MAX_TRAIN = 3000  # texts of a language that are learnt from
LANGUAGES = 250  # languages that are learnt
BUCKETS = 1 << 15  # of each n-gram length
ORDERS = (1, 2, 3, 4)
SWITCH = 12.0  # what a change of language between words costs, in nats
SMOOTH = 0.5
COUNTERS = 16  # tasks that count the sample
RARE_SCRIPT = 0.005  # a language is a candidate for a script that has this share of its training letters
UND = "und"

# First and last code point of the letters of each script. Anything else is "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)],
}
SCRIPT_NAMES = (*SCRIPTS, "other")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, script


class Letters:
    """The words (runs of letters) of many texts: lower-cased code points, word bounds and documents."""

    def __init__(self, texts: list[str]):
        letter, script = kept("letters", _tables)
        low = [y if len(y := x.lower()) == len(x) else "".join(c.lower()[0] for c in x) for x in texts]
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(x) + 1 for x in low), np.int64, len(low))
        self.doc_start = np.cumsum(sizes) - sizes
        # A word also ends where the script changes, so that each has one.
        kind = np.where(letter[code], script[code].astype(np.int16) + 1, 0)
        edge = np.flatnonzero(np.diff(np.r_[0, kind]))
        start = edge[kind[edge] > 0]
        after = np.r_[edge, len(code)]
        self.code, self.start = code, start
        self.end = after[np.searchsorted(edge, start) + 1]
        self.script = (kind[start] - 1).astype(np.int64)
        self.doc = np.searchsorted(self.doc_start, start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order: row of the score table and word, of each n-gram. A word is framed by one mark on each side."""
        size = self.end - self.start + 2
        at = np.cumsum(size) - size
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        framed = self.code[np.minimum(np.repeat(self.start, size) + place - 1, len(self.code) - 1)].astype(np.uint32)
        framed[(place == 0) | (place == np.repeat(size, size) - 1)] = 1
        value = np.zeros(len(framed), np.uint32)
        for k, n in enumerate(ORDERS):
            if len(framed) < n:
                return
            value = (value[: len(framed) - n + 1] * np.uint32(0x01000193)) ^ (framed[n - 1 :] * np.uint32(0x9E3779B1))
            inside = word[: len(value)] == word[n - 1 :]
            mixed = value[inside]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (mixed >> np.uint32(32 - 15)).astype(np.int64) + k * BUCKETS, word[: len(value)][inside]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (n-gram rows, languages): log share of the n-gram in the language
    scripts: np.ndarray  # (scripts, languages): whether a language is a candidate


def fit(docs: DataFrame, lang: str = "lang") -> Model:
    """A model of the columns ``text`` and ``lang``.

    The texts of a language that are used are those below the hash value that ``MAX_TRAIN`` of them are expected to be
    below, each once; the driver gets a table of counts of the model's fixed size."""
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r.name: r.n for r in known.groupBy(F.col(lang).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    limit = F.create_map(*[F.lit(y) for x in languages for y in (x, int(min(1.0, MAX_TRAIN / counts[x]) * SLOTS))])
    # The bounded sample leaves the tasks that scan the table for a few that count it.
    sample = drawn(known.select(F.col(lang).alias("lang"), "text"), limit[F.col("lang")], ["lang", "text"]).repartition(COUNTERS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ORDERS) * BUCKETS + len(SCRIPT_NAMES), len(languages)), np.int64)
        for batch in slices(batches):
            words = Letters(texts_of(batch))
            own = np.array([languages.index(x) for x in column(batch, "lang").to_pylist()], np.int64)[words.doc]
            for row, word in words.features():
                total += np.bincount(row * len(languages) + own[word], minlength=total.size).reshape(total.shape)
            np.add.at(total, (len(ORDERS) * BUCKETS + words.script, own), words.end - words.start)
        row, lang_id = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(lang_id), pa.array(total[row, lang_id])], ["row", "lang_id", "n"])

    found = sample.mapInArrow(count, "row long, lang_id long, n long").groupBy("row", "lang_id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(ORDERS) * BUCKETS + len(SCRIPT_NAMES), len(languages)))
    total[found["row"].to_numpy(np.int64), found["lang_id"].to_numpy(np.int64)] = found["n"].to_numpy()
    grams, letters = total[:-len(SCRIPT_NAMES)], total[-len(SCRIPT_NAMES) :]
    parts = []
    for k in range(len(ORDERS)):
        part = grams[k * BUCKETS : (k + 1) * BUCKETS] + SMOOTH
        share = np.log(part / part.sum(axis=0))
        parts.append((share - share.mean(axis=1, keepdims=True)) / len(ORDERS) * 2)
    return Model(languages, np.concatenate(parts).astype(np.float32), letters >= RARE_SCRIPT * np.maximum(1, letters.sum(axis=0)))


def word_scores(model: Model, words: Letters) -> np.ndarray:
    """(words, languages). A language that does not use a word's script is out, unless none does."""
    out = np.zeros((len(words.start), len(model.languages)), np.float32)
    if not len(out):
        return out
    for row, word in words.features():
        if len(row):
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[word[at]] += np.add.reduceat(model.scores[row], at, axis=0)
    allowed = model.scripts[words.script]
    none = ~allowed.any(axis=1)
    out[none] = 0
    return np.where(allowed | none[:, None], out, np.float32(-1e4))


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. All texts advance word by word together, the longest first, so that a text that has
    ended costs nothing more."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    out = np.zeros(len(scores), np.int64)
    if not len(scores):
        return out
    back = np.zeros(scores.shape, np.int16)
    value = np.zeros((len(size), scores.shape[1]), np.float32)
    own = np.arange(scores.shape[1], dtype=np.int16)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    for t in range(size[0]):
        n = alive[t]
        at = begin[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            other = now[np.arange(n), best] - np.float32(switch)
            jump = other[:, None] > now
            back[at] = np.where(jump, best[:, None], own)
            now = np.where(jump, other[:, None], now)
        value[:n] = now + scores[at]
    state = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


NAMES = ("lang_pred", "score", "lang_spans")


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = True, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The columns ``keep`` (the id alone if not given) with ``lang_pred``, ``score`` (share of the letters that are in
    spans of that language) and ``lang_spans``: start and end (code points) of each stretch and its language."""
    keep = keep or ["doc_id"]
    # A text that is kept is sent to Python once, and all by plain names.
    inside = [f"keep_{k}" for k in range(len(keep))]
    name = inside[keep.index(text_col)] if text_col in keep else "text"
    source = docs.select(*[x.alias(y) for x, y in zip(quoted(keep), inside, strict=True)], *([] if text_col in keep else [quoted([text_col])[0].alias(name)]))
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, name, limit=400_000):
            words = Letters(texts_of(batch, name))
            n = batch.num_rows
            label, score, found = [UND] * n, np.zeros(n), [[] for _ in range(n)]
            if model.languages and len(words.start):
                path = viterbi(word_scores(model, words), words.first)
                length = words.end - words.start
                share = np.bincount(words.doc * len(model.languages) + path, length, n * len(model.languages)).reshape(n, -1)
                total = share.sum(axis=1)
                for i in np.flatnonzero(total):
                    label[i] = model.languages[best := int(share[i].argmax())]
                    score[i] = share[i, best] / total[i]
                if spans:
                    edge = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (words.doc[1:] != words.doc[:-1])])
                    stop = np.r_[edge[1:], len(path)] - 1
                    for a, b, d in zip(edge.tolist(), stop.tolist(), words.doc[edge].tolist(), strict=True):
                        zero = words.doc_start[d]
                        found[d].append({"start": int(words.start[a] - zero), "end": int(words.end[b] - zero), "lang": model.languages[path[a]]})
            yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in inside], pa.array(label), pa.array(score), pa.array(found, kind)], [*keep, *names])

    schema = ", ".join(f"`{x}` {types[x]}" for x in keep) + f", `{names[0]}` string, `{names[1]}` double, `{names[2]}` array<struct<start:bigint,end:bigint,lang:string>>"
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is never learnt from: CRC-32 of the id as text, modulo ``folds``, is ``fold``. A null id counts as
    learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
