"""Benchmark decontamination. A CGK random walk (Chakraborty, Goldenberg, Koucky, 2016) maps the words of a window to a
string in which edit distance has become Hamming distance; repeated bit-sampling LSH over item-sized windows finds the
items that a window may be near; exact edit distance decides.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in lower case; so case and marks between
words don't matter. An item of n words is found where some stretch of a text is within ``floor(0.2 n)`` word edits of it.

1. One pass over the documents lays windows of n words, n being each length that items have, at every place where enough
   short runs of words are in some item of n words: the q-gram lemma says how many a near stretch must share, so this
   filter names no item and loses no stretch (``filtered=False`` lays windows everywhere and gives the same rows). Windows
   side by side are one row, a region, which is all that is kept of a document.
2. Each window is embedded by ``WALKS`` random walks, in long windows each over a stretch of it, since the distance after
   the walk grows with the square of the edits. ``TABLES`` samples of ``BITS`` of the places that walks reach well before
   their stretch ends make its keys, and those of the items are made alike. Keys are joined: a window and an item
   that agree in one table are a candidate, and there are no others. Samples beyond the end of a window are no key.
3. The candidates' regions and items are joined and the exact edit distance of the item to any stretch is taken.

``tests/llm/test_decontaminate.py`` holds the recall against plain edit distance over all places of all texts.

Nothing grows with the benchmark but joins: what is broadcast are two bit sets, of the items' runs of words and of
their keys, whose size follows their number up to ``MOST_BITS`` bits (128 MB); fuller sets only filter less. Documents are
read once and not shuffled. A task holds one whole text's words at a time (about 60 bytes a word), and regions of at most
``REGION`` windows.

Null or empty texts and items without words match nothing. Rows without id are left out. Repeated rows give one report
for a document and an item; of several stretches or texts of one id the least distance counts, then the first start and
end. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import Words, bit_set, column, grams, has_bit, mix, slices, stored, texts_of

PERCENT = 20  # word edits allowed, of the words of an item
WALKS, TABLES, BITS, REACH = 16, 64, 4, 1.5  # samples are taken from this many steps a word of a walk, of 3 that it may need
STRETCH = 40  # words that a walk sees; in longer windows the walks' beginnings are spread evenly
GRAM_WORDS = 3
REGION, WINDOWS = 4096, 512  # windows of a region, and those that are embedded at a time
MOST_BITS = 1 << 30

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SAMPLE = np.random.default_rng(20)
SAMPLES = [(k % WALKS, np.sort(_SAMPLE.random(BITS))) for k in range(TABLES)]
_LANES = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

DDL = "doc_id long, item_id long, distance int, n_words int, start long, end long"


def words_of(texts: list[str]) -> Words:
    """Words of the texts in lower case; a text whose lower case has another length is lowered in A-Z only."""
    return Words([y if len(y := x.lower()) == len(x) else x for x in texts], _GAP)


def allowed(n: int, percent: int = PERCENT) -> int:
    return percent * n // 100


# ----------------------------------------------------------------------------------------------------- embedding and keys


def embed(words: np.ndarray, walk: np.ndarray, steps: int) -> np.ndarray:
    """CGK strings of the rows of ``words``, which end with zeros, each by its own walk. At each step a row gives the word
    it stands on, and then goes on or stays by a coin that hangs on the walk, the word and the step alone."""
    rows, width = words.shape
    padded = np.concatenate([words, np.zeros((rows, 1), np.uint64)], axis=1).ravel()
    out = np.zeros((steps, rows), np.uint64)
    first = np.arange(rows) * (width + 1)
    at, last = first.copy(), first + width
    salt = (walk.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(steps):
        now = out[j] = padded[at]
        coin = mix(now + salt + np.uint64((j + 1) * 0xC2B2AE3D27D4EB4F & (2**64 - 1))) >> np.uint64(63)
        at = np.minimum(at + coin.astype(np.int64), last)
    return out


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each table's sample of the rows' strings; samples that hold the end of a row are left out."""
    count, n = words.shape
    width = min(n, STRETCH)
    begin = [(n - width) * walk // (WALKS - 1) for walk in range(WALKS)]
    string = embed(np.concatenate([words[:, b : b + width] for b in begin]), np.repeat(np.arange(WALKS), count), int(REACH * width) + 1)
    rows, values = [], []
    for table, (walk, share) in enumerate(SAMPLES):
        picked = string[(share * REACH * width).astype(np.int64), walk * count : (walk + 1) * count]
        full = np.flatnonzero((picked != 0).all(axis=0))
        salt = np.uint64((n * TABLES + table) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        rows.append(full)
        values.append(mix(mix(picked[:, full] * _LANES[:, None]).sum(axis=0, dtype=np.uint64) + salt))
    return np.concatenate(rows), np.concatenate(values)


# ------------------------------------------------------------------------------------------------------- filter of windows


def gram_size(n: int, percent: int = PERCENT) -> int:
    """Words of the runs that a stretch near an item of n words must share: so short that one run at least is left."""
    return min(GRAM_WORDS, n // (allowed(n, percent) + 1))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """How many runs a stretch near an item of n words shares with it: each edit breaks one for each of its words at most."""
    q = gram_size(n, percent)
    return n - q + 1 - allowed(n, percent) * q


def _of_length(gram: np.ndarray, n: int) -> np.ndarray:
    return mix(gram + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))


def item_grams(words: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of an item's runs, each alone and together with the item's length."""
    single = Words.__new__(Words)
    single.hash, single.doc = words, np.zeros(len(words), np.int64)
    value = grams(single, gram_size(len(words), percent))[0]
    return np.concatenate([value, _of_length(value, len(words))])


def windows(words: Words, known: np.ndarray, lengths: list[int], percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, n, first, last): places from first to last where a window of n words begins, at most ``REGION`` of them."""
    for q in {gram_size(n, percent) for n in lengths}:
        value = grams(words, q)[0]
        size = max(len(words.hash) - q + 1, 0)
        place = np.flatnonzero(words.doc[:size] == words.doc[q - 1 :])
        hit = np.flatnonzero(has_bit(known, value))
        value, place = value[hit], place[hit]
        for n in [n for n in lengths if gram_size(n, percent) == q] if len(hit) else []:
            at = place[has_bit(known, _of_length(value, n))]
            need, reach = least_shared(n, percent), n + allowed(n, percent) - q
            if len(at) < need:
                continue
            # A window is laid at each place with enough runs within reach, from that place on.
            first, last = at[: len(at) - need + 1], at[need - 1 :]
            low = np.maximum(last - reach, words.first[words.doc[first]])
            near = np.flatnonzero((low <= first) & (words.doc[first] == words.doc[last]))
            if not len(near):
                continue
            low, high, doc = low[near], first[near], words.doc[first[near]]
            edge = np.flatnonzero(np.r_[True, (low[1:] > high[:-1] + 1) | (doc[1:] != doc[:-1])])
            for a, b, d in zip(low[edge].tolist(), high[np.r_[edge[1:], len(low)] - 1].tolist(), doc[edge].tolist(), strict=True):
                for begin in range(a, b + 1, REGION):
                    yield d, n, begin, min(b, begin + REGION - 1)


def everywhere(words: Words, lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    for d, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        for n in lengths if b > a else []:
            for begin in range(a, b, REGION):
                yield d, n, begin, min(b, begin + REGION) - 1


# ------------------------------------------------------------------------------------------------------------ verification


def distance(item: list[int], text: list[int]) -> tuple[int, int]:
    """Least number of word edits that make the item a stretch of the text, and where the first such stretch ends
    (Myers' bit-parallel form)."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        h_up = (down | ~(d0 | up)) & full
        h_down = up & d0
        score += bool(h_up & top) - bool(h_down & top)
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up = (h_down | ~(d0 | h_up)) & full
        down = h_up & d0
        if score < best[0]:
            best = (score, j + 1)
    return best


def nearest(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Distance, first and last word (exclusive) of the first stretch that is nearest."""
    d, stop = distance(item, text)
    back, taken = distance(item[::-1], text[:stop][::-1])
    return d, stop - taken if back == d else 0, stop


# -------------------------------------------------------------------------------------------------------------------- plan


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edge = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(edge), pa.array(flat, kind))


def _items(benchmark: DataFrame) -> DataFrame:
    """``item``, ``item_id``, ``n`` and ``words`` of each item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(texts_of(batch))
            own = [words.hash[a:b].view(np.int64) for a, b in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in ("item", "item_id")], pa.array([len(x) for x in own], pa.int32()), _lists(own, pa.int64())], ["item", "item_id", "n", "words"])

    known = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    numbered = known.withColumn("item", F.xxhash64("item_id", "text"))
    return stored(numbered.mapInArrow(run, "item long, item_id long, n int, words array<bigint>").where("n > 0"), "items")


def _hashes(items: DataFrame, kind: str, percent: int) -> DataFrame:
    """The items' run hashes (``grams``) or keys, as ``item`` and ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = column(batch, "item").to_pylist(), []
            for x in column(batch, "words").to_pylist():
                own = np.array(x, np.int64).view(np.uint64)
                out.append(np.unique(item_grams(own, percent) if kind == "grams" else keys(own[None, :])[1]).view(np.int64))
            sizes = [len(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes)), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))], ["item", "h"])

    return items.select("item", "words").mapInArrow(run, "item long, h long")


def _regions(docs: DataFrame, known, lengths: list[int], percent: int, filtered: bool) -> DataFrame:
    """``region``, ``doc_id``, ``n``, ``n_windows``, ``words`` from the first window's beginning to the end of any stretch
    that begins in the last one's, and the words' ``starts`` and ``ends`` (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = TaskContext.get().partitionId() << 36
        for batch in slices(batches, limit=1_500_000):
            words = words_of(texts_of(batch))
            if not len(words.hash):
                continue
            found = list(windows(words, known.value, lengths, percent) if filtered else everywhere(words, lengths))
            if not found:
                continue
            point = np.r_[0, np.cumsum((words.bytes & 0xC0) != 0x80)]
            zero = point[words.doc_start]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                stretch = [slice(a, min(b + n + allowed(n, percent), int(words.first[d + 1]))) for d, n, a, b in part]
                number = np.arange(region, region + len(part))
                region += len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number), column(batch, "doc_id").take(pa.array([d for d, *_ in part])), pa.array([n for _, n, *_ in part], pa.int32()), pa.array([b - a + 1 for *_, a, b in part], pa.int32()),
                        _lists([words.hash[s].view(np.int64) for s in stretch], pa.int64()),
                        *[_lists([point[edge[s]] - zero[d] for s, (d, *_) in zip(stretch, part, strict=True)], pa.int64()) for edge in (words.start, words.end)],
                    ],
                    ["region", "doc_id", "n", "n_windows", "words", "starts", "ends"],
                )

    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "region long, doc_id long, n int, n_windows int, words array<bigint>, starts array<bigint>, ends array<bigint>")


def _window_keys(regions: DataFrame, known) -> DataFrame:
    """``region`` and ``h``: the keys of its windows that some item may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, lengths, counts = (column(batch, x).to_numpy() for x in ("region", "n", "n_windows"))
            edge = np.cumsum([0, *column(batch, "words").value_lengths().to_pylist()])
            # Beyond its region's words a window has zeros.
            values = np.concatenate([column(batch, "words").flatten().to_numpy().view(np.uint64), np.zeros(1, np.uint64)])
            for n in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == n)
                region = np.repeat(own, counts[own])
                place = edge[region] + np.arange(len(region)) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
                for low in range(0, len(region), WINDOWS):
                    which = region[low : low + WINDOWS]
                    at = place[low : low + WINDOWS, None] + np.arange(n)
                    row, value = keys(values[np.where(at < edge[which + 1][:, None], at, -1)])
                    known_ = has_bit(known.value, value)
                    pair = np.unique(np.stack([numbers[which[row[known_]]], value[known_].view(np.int64)]), axis=1)
                    if pair.size:
                        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["region", "h"])

    return regions.select("region", "n", "n_windows", "words").mapInArrow(run, "region long, h long")


def _verified(both: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                d, a, b = nearest(row["item_words"], row["words"])
                if d <= allowed(len(row["item_words"]), percent):
                    rows.append((row["doc_id"], row["item_id"], d, len(row["item_words"]), row["starts"][a], row["ends"][b - 1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DDL.split(", ")])

    return both.mapInArrow(run, DDL)


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, filtered: bool = True) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance``, ``n_words`` of the item, and ``start`` and ``end`` (code points) of the
    stretch, for each document and item that are near; ``docs`` has ``doc_id``, ``text``, ``benchmark`` ``item_id``,
    ``text``."""
    spark = docs.sparkSession
    items = _items(benchmark)
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    gram_bits = spark.sparkContext.broadcast(bit_set(_hashes(items, "grams", percent).select("h"), MOST_BITS))
    item_keys = stored(_hashes(items, "keys", percent), "item_keys")
    key_bits = spark.sparkContext.broadcast(bit_set(item_keys.select("h"), MOST_BITS))

    regions = stored(_regions(docs, gram_bits, lengths, percent, filtered), "regions")
    pairs = _window_keys(regions, key_bits).join(item_keys, "h").select("region", "item").distinct()
    near = pairs.join(regions, "region").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    best = F.min(F.struct("distance", "start", "end", "n_words")).alias("b")
    found = _verified(near.select("doc_id", "item_id", "item_words", "words", "starts", "ends"), percent)
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.distance", "b.n_words", "b.start", "b.end")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item is found in; those without id or text stay."""
    return docs.join(contamination(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
