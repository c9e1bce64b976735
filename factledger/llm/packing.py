"""Best-fit packing of documents into sequences by a grouping genetic algorithm (Falkenauer, 1996) on islands.

Documents are dealt by hash into shards of about ``SHARD`` pieces, so the work grows in proportion to the corpus and no
task holds more than a shard. Each shard is evolved on several islands. A chromosome is a set of bins. Crossover injects
whole well-filled bins of one parent into the other, takes out the bins that hold any of the injected pieces, and
best-fits the displaced pieces, largest first; mutation empties the worst bins and some others and fills them again, each
as full as some of the ``CHOICE`` pieces tried can make it. Between epochs each island's elite migrates to the next one, by
a join. The best elite of a shard is its packing. A shard whose number of bins cannot be lowered (its lengths' sum says so)
is done; on texts with many short pieces best fit alone often gets there, on lengths that are hard to combine the
algorithm needs 2 % fewer sequences than best fit (``tests/llm/test_packing.py``). Bins that are less than
``WELL_FILLED`` full are opened, and their pieces are dealt anew and packed in a second round.

A document is its ids and the end id 0; only longer ones than a sequence are cut. Null and empty texts are the end id
alone. Rows without id are packed like others. Other columns than ``doc_id`` and ``text`` are not read. A very long text is
held, with its ids, by one task; its pieces then go their own ways. Repeated rows are separate documents. Ties go to the earlier piece. An empty table gives an empty result. Full
pieces are sequences of their own. Random choices come from the shard, the island and the epoch, so a task that runs
again gives the same bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import column, slices, stored, texts_of
from factledger.llm.encode import encoder
from factledger.llm.tokenfile import END

CAPACITY = 2048
SHARD = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4, 3, 8, 24
CHOICE = 48
TASKS = 8192  # that shards and islands are dealt to, at most
WELL_FILLED = 0.985
INJECTED = 0.5  # share of a parent's bins that crossover may inject, the fullest first


# ------------------------------------------------------------------------------------------------------------ algorithm


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, free: list[int]) -> None:
    """Put ``items`` in the order given each into the bin that it fills best, opening bins as needed; in place."""
    room = sorted((space, b) for b, space in enumerate(free) if space)
    for i, size in zip(items.tolist(), lengths[items].tolist(), strict=True):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            space, b = room.pop(at)
        else:
            space, b = CAPACITY, len(free)
            free.append(CAPACITY)
        bins[i] = b
        free[b] = space - size
        if space > size:
            insort(room, (space - size, b))


def decreasing(lengths: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
    """Best-fit decreasing; with a generator, by lengths that are each disturbed by up to a tenth."""
    key = lengths if rng is None else lengths * rng.uniform(0.9, 1.0, len(lengths))
    bins = np.zeros(len(lengths), np.int64)
    best_fit(lengths, np.argsort(-key, kind="stable"), bins, [])
    return bins


def fills(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray) -> float:
    """Mean square of how full the bins are: higher for fewer bins, and for fuller ones at the same number."""
    full = fills(lengths, bins) / CAPACITY
    return float((full * full).mean())


def _rebuilt(lengths: np.ndarray, bins: np.ndarray, loose: np.ndarray) -> np.ndarray:
    """The chromosome after the loose pieces have been best-fitted, largest first, into what is left of it."""
    out = np.full(len(bins), -1, np.int64)
    kept = ~loose
    used, number = np.unique(bins[kept], return_inverse=True)
    out[kept] = number
    free = (CAPACITY - np.bincount(number, lengths[kept], len(used))).astype(np.int64).tolist()
    items = np.flatnonzero(loose)
    best_fit(lengths, items[np.argsort(-lengths[items], kind="stable")], out, free)
    return out


def crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    full = fills(lengths, giver)
    order = np.argsort(-full, kind="stable")[: max(1, int(len(full) * INJECTED))]
    chosen = order[rng.random(len(order)) < rng.uniform(0.2, 0.8)]
    mark = np.zeros(len(full), bool)
    mark[chosen] = True
    injected = mark[giver]
    hit = np.zeros(taker.max() + 1, bool)
    hit[taker[injected]] = True
    child = taker + len(full)
    child[injected] = giver[injected]
    return _rebuilt(lengths, child, hit[taker] & ~injected)


def filled(sizes: list[int], room: int) -> list[int]:
    """Positions of sizes that fill the room best: the largest sum that some of them reach, by a set of reachable sums."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in sizes:
        steps.append(reach)
        reach |= (reach << size) & mask
    total, out = reach.bit_length() - 1, []
    for k in range(len(sizes) - 1, -1, -1):
        if not steps[k] >> total & 1:
            out.append(k)
            total -= sizes[k]
    return out


def mutated(lengths: np.ndarray, bins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Empties a part of the bins, the worst and some others, and fills bins with what was in them: each with the largest
    piece left and those of ``CHOICE`` others that fill it best."""
    full = fills(lengths, bins)
    chosen = np.zeros(len(full), bool)
    chosen[np.argsort(full, kind="stable")[: max(1, int(len(full) * rng.uniform(0.05, 0.3)))]] = True
    chosen[rng.integers(0, len(full), max(1, len(full) // 20))] = True
    loose = np.flatnonzero(chosen[bins])
    out = np.full(len(bins), -1, np.int64)
    used, number = np.unique(bins[~chosen[bins]], return_inverse=True)
    out[~chosen[bins]] = number
    left = loose[np.argsort(-lengths[loose], kind="stable")].tolist()
    size, b = lengths.tolist(), len(used)
    while left:
        first, left = left[0], left[1:]
        out[first] = b
        # The smallest pieces make any rest, the others are spread over all sizes.
        step = max(1, len(left) // CHOICE)
        tried = list(range(int(rng.integers(step)), len(left), step))[:CHOICE]
        picked = [tried[k] for k in filled([size[left[k]] for k in tried], CAPACITY - size[first])]
        for k in sorted(picked, reverse=True):
            out[left.pop(k)] = b
        b += 1
    return out


def lower_bound(lengths: np.ndarray) -> int:
    return -(-int(lengths.sum()) // CAPACITY)


def evolve(lengths: np.ndarray, elites: list[np.ndarray], rng: np.random.Generator) -> np.ndarray:
    """The best chromosome after one epoch from the elites and fresh ones. Without elites: best-fit decreasing."""
    population = elites or [decreasing(lengths)]
    if not elites or any(x.max() + 1 == lower_bound(lengths) for x in population):
        return min(population, key=lambda x: x.max())
    population = population + [decreasing(lengths, rng) for _ in range(POPULATION - len(population))]
    ranked = sorted(((fitness(lengths, x), k, x) for k, x in enumerate(population)), key=lambda x: (-x[0], x[1]))
    for k in range(GENERATIONS):
        if ranked[0][2].max() + 1 == lower_bound(lengths):
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], rng)
        if rng.random() < 0.5:
            child = mutated(lengths, child, rng)
        ranked[-1] = (fitness(lengths, child), POPULATION + k, child)
        ranked.sort(key=lambda x: (-x[0], x[1]))
    return ranked[0][2]


# ------------------------------------------------------------------------------------------------------------------ plan


def _numbers(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False).astype(np.int64)


def _one_list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int64()))


def _evolved(shards: DataFrame, epoch: int) -> DataFrame:
    """shard, island, lengths, elites in; shard, island, bins, fit, and whether no packing has fewer bins, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, island = (column(batch, x)[i].as_py() for x in ("shard", "island"))
                lengths = _numbers(column(batch, "lengths")[i])
                bins = evolve(lengths, [_numbers(x) for x in column(batch, "elites")[i].values], np.random.default_rng([shard, island, epoch]))
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([island], pa.int32()), _one_list(bins), pa.array([fitness(lengths, bins)]), pa.array([bool(bins.max() + 1 == lower_bound(lengths))])], ["shard", "island", "bins", "fit", "done"])

    return shards.select("shard", "island", "lengths", "elites").mapInArrow(run, "shard long, island int, bins array<bigint>, fit double, done boolean")


def pack_pieces(pieces: DataFrame, salt: int = 0) -> DataFrame:
    """``uid``, ``length`` (below the capacity) in; ``uid``, ``length``, ``shard``, ``bin``, ``offset`` and the bin's
    ``fill`` out."""
    shards = max(1, -(-pieces.count() // SHARD))
    dealt = pieces.select(F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(shards)).alias("shard"), F.struct("length", "uid").alias("x"))
    whole = stored(dealt.groupBy("shard").agg(F.sort_array(F.collect_list("x"), False).alias("x")).select("shard", F.col("x.length").alias("lengths"), F.col("x.uid").alias("uids")), "shards")
    # Rows are few and cost much: without a number they would be put together in few tasks.
    dealt_out = lambda x, n: x.repartition(max(1, min(n, TASKS)), "shard", "island")
    start = dealt_out(whole.select("shard", "lengths", F.lit(0).alias("island")), -(-shards // 4)).withColumn("elites", F.array().cast("array<array<bigint>>"))
    now = stored(_evolved(start, 0), "elites")
    every = [now]
    left = now.where("not done").count()
    if left:
        # Only shards that best fit has not packed as well as can be are evolved.
        hard = stored(whole.join(now.where("not done").select("shard", "bins"), "shard"), "hard")
        island = hard.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
        ready = hard.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.array("bins").alias("elites"))
        for epoch in range(1, EPOCHS + 1):
            now = stored(_evolved(dealt_out(ready, left * ISLANDS), epoch), "elites")
            every.append(now)
            own = now.select("shard", "island", F.col("bins").alias("own"))
            migrant = now.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("migrant"))
            open_ = island.join(now.where("done").select("shard").distinct(), "shard", "left_anti")
            ready = open_.join(own, ["shard", "island"]).join(migrant, ["shard", "island"]).withColumn("elites", F.array("own", "migrant"))
    found = every[0]
    for more in every[1:]:
        found = found.unionByName(more)
    best = found.groupBy("shard").agg(F.max_by("bins", F.struct("fit", -F.col("island"))).alias("bins"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uids, lengths, bins = (_numbers(column(batch, x)[i]) for x in ("uids", "lengths", "bins"))
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.searchsorted(bins[order], np.arange(bins.max() + 1))
                offset = np.empty_like(before)
                offset[order] = before - before[first][bins[order]]
                shard = np.full(len(bins), column(batch, "shard")[i].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uids, lengths, shard, bins, offset, fills(lengths, bins)[bins])], ["uid", "length", "shard", "bin", "offset", "fill"])

    return whole.join(best, "shard").repartition(max(1, min(-(-shards // 4), TASKS)), "shard").mapInArrow(places, "uid long, length long, shard long, bin long, offset long, fill long")


def pieces_of(docs: DataFrame, path: str, kind: str = "word") -> DataFrame:
    """``uid``, ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of each document cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, kind).ids
        uid = TaskContext.get().partitionId() << 40
        size = 4 * CAPACITY
        for batch in slices(batches):
            rows = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                raw = ids(text) + END
                for at in range(0, len(raw), size):
                    cut = raw[at : at + size]
                    rows.append((uid, doc, at // size, at // 4, len(cut) // 4, zlib.crc32(cut)))
                    uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, kind: str = "word") -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` of each piece of
    ``doc_id``, ``text``."""
    pieces = stored(pieces_of(docs, path, kind), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == CAPACITY).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    first = stored(pack_pieces(pieces.where(F.col("length") < CAPACITY).select("uid", "length")), "packed")
    poor = F.col("fill") < WELL_FILLED * CAPACITY
    again = stored(pack_pieces(first.where(poor).select("uid", "length"), salt=1), "packed")
    # The second round counts only if it needs fewer bins.
    better = again.select("shard", "bin").distinct().count() < first.where(poor).select("shard", "bin").distinct().count()
    number = lambda n: (F.col("shard") * 2 + n) * (1 << 24) + F.col("bin")
    done = first.where(~poor) if better else first
    placed = done.select("uid", number(0).alias("sequence_id"), "offset")
    if better:
        placed = placed.unionByName(again.select("uid", number(1).alias("sequence_id"), "offset"))
    return full.unionByName(pieces.join(placed, "uid").select(*columns, "sequence_id", "offset"))
