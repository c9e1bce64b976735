"""Exact Jaccard self-join of word-shingle sets, with signature trees.

Texts with equal sets form a class; classes are compared, copies never are. The plan:

1. One pass gives each text its set size, a digest of its set and a token bitmap, and counts the shingles that are
   frequent in a task's stretch of the table. The counts only settle an order of shingles, rarest first.
2. A second pass emits the first n - ceil(0.8 n) + 1 shingles of each set in that order. Two sets that reach the
   threshold share one of these at least, so grouping by shingle loses no pair.
3. Two sets are candidates if their sizes and bitmaps allow the overlap that they need. Members of a group are tried
   against the group's smallest set of like size; the candidate pairs give first clusters.
4. Groups that still hold several clusters are joined by signature trees: a node holds the OR of the bitmaps below it and
   their range of sizes; the tree is traversed against itself, and a pair of nodes goes no further if the largest
   possible overlap is too small or all below is one cluster already. Groups with the same members are joined once. Only
   pairs that join two clusters are given out, so the rows grow with the members, not with their square.
5. The texts of each cluster, and few others, are shuffled and meet once, and every pair of a cluster that sizes and
   bitmaps allow is verified on exact sets. Links are counted for each class where they are found, so a task gives out one
   row a member, and the links that join components.

A component and a number of links are therefore exact. Large groups and clusters are dealt out as pairs of blocks of bounded size, so no task
holds more than two blocks, and one whole text at a time before that (about 100 bytes a word). Rows without id are left
out. Null and empty texts and texts without words have an empty set, size 0, and are linked with nothing. An empty table
gives an empty result. Repeated rows and equal texts are one class; ids count once in a class. Classes that
have one least id (rows that share it, with other texts) are not counted against each other. Extra columns are ignored.
Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import column, flat, possibly, shingle_sets, slices, stored, texts_of
from factledger.llm.components import components

N_WORDS, PERCENT = 5, 80
BLOCK, TEXT_BLOCK = 1024, 512  # members of a group, and texts of a cluster, that a block holds
FANOUT = 8
COLUMNS = 16384  # shingles that the exact comparison holds at a time
TREE_BITS = 1024
SLICE = 500_000  # bytes of text that a task hashes at a time
#: A shingle is frequent if it is in this share of the texts; so the list has at most 1 / share times the mean set size.
FREQUENT, FREQUENT_LEAST, STRETCH = 2e-4, 16, 3_000_000


def least_overlap(total: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of two sets whose sizes add up to ``total``: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


# ------------------------------------------------------------------------------------------------------------- bitmaps


def bitmap(shingles: np.ndarray) -> bytes:
    """Token bitmap with a power of two of bits, 1.5 a shingle at least and 1024 at least."""
    bits = TREE_BITS
    while bits < 1.5 * len(shingles):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(shingles >> np.uint64(3)) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap with ``size`` bytes, halves combined by OR."""
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_reach(a: bytes, b: bytes, n_a: int, n_b: int, percent: int = PERCENT) -> bool:
    """Whether the bitmaps allow the overlap that two sets of these sizes need."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    x, y = folded(x, size), folded(y, size)
    common = int(np.bitwise_count(x & y).sum())
    slack = min(n_a - int(np.bitwise_count(x).sum()), n_b - int(np.bitwise_count(y).sum()))
    return slack + common >= least_overlap(n_a + n_b, percent)


def widths(bits: list[bytes], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each width (bytes) that bitmaps have: the positions of the sets of this width and of those that a near set may
    have, and whether each has this one. A pair belongs to its smaller width; so bitmaps are as wide as their sets need,
    however different the sets of a group are."""
    size, most = np.array([len(x) for x in bits]), 2
    while percent * most < 100:
        most *= 2
    for width in np.unique(size).tolist():
        at = np.flatnonzero((size >= width) & (size <= most * width))
        yield width, at, size[at] == width


def signatures(bits: list[bytes], at: np.ndarray, width: int) -> np.ndarray:
    return np.stack([folded(np.frombuffer(bits[k], np.uint8), width) for k in at.tolist()]).view(np.uint64)


class SignatureTree:
    """Levels of nodes over sets sorted by label and size; level 0 are the sets. ``narrow`` marks sets of which a pair must
    have one at least."""

    def __init__(self, sizes: np.ndarray, signature: np.ndarray, label: np.ndarray, narrow: np.ndarray):
        self.order = np.lexsort((sizes, label))
        s, n, g, w = signature[self.order], sizes[self.order], label[self.order], narrow[self.order]
        self.levels = [(s, n, n, n - np.bitwise_count(s).sum(axis=1).astype(np.int64), g, g, w)]
        self.step = max(1, (1 << 22) // (FANOUT * FANOUT * s.nbytes // max(1, len(s))))  # pairs of nodes opened at a time: some MB
        while len(self.levels[-1][0]) > 1:
            s, low, high, slack, g_low, g_high, w = self.levels[-1]
            at = np.arange(0, len(s), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(s, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at), np.minimum.reduceat(g_low, at), np.maximum.reduceat(g_high, at), np.logical_or.reduceat(w, at)))

    def _kept(self, depth: int, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes that may hold a pair of sets that is near and not of one label."""
        s, low, high, slack, g_low, g_high, w = self.levels[depth]
        one = (g_low[a] == g_high[a]) & (g_low[b] == g_high[b]) & (g_low[a] == g_low[b])
        keep = ~one & (w[a] | w[b]) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        a, b = a[keep], b[keep]
        # Of two sets the smaller slack bounds the overlap; of nodes only the larger one does.
        spare = (np.maximum if depth else np.minimum)(slack[a], slack[b])
        overlap = spare + np.bitwise_count(s[a] & s[b]).sum(axis=1).astype(np.int64)
        keep = (100 + percent) * overlap >= percent * (low[a] + low[b])
        return a[keep], b[keep]

    def self_join(self, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in the order given) of the pairs of sets that no bound rules out, some thousands at a time."""
        step = np.arange(FANOUT)
        a = b = np.zeros(1, np.int64)
        a, b = self._kept(len(self.levels) - 1, a, b, percent)
        for depth in range(len(self.levels) - 2, -1, -1):
            width = len(self.levels[depth][0])
            parts = []
            for at in range(0, len(a), self.step):
                x, y = (v.ravel() for v in np.broadcast_arrays(a[at : at + self.step, None, None] * FANOUT + step[None, :, None], b[at : at + self.step, None, None] * FANOUT + step[None, None, :]))
                keep = (x <= y if depth else x < y) & (y < width)
                parts.append(self._kept(depth, x[keep], y[keep], percent))
                if not depth:
                    yield self.order[parts[-1][0]], self.order[parts.pop()[1]]
            if depth:
                a, b = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))


def joining_pairs(sizes: np.ndarray, bits: list[bytes], label: np.ndarray, near, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Near pairs that join the labels as far as near pairs can: ``near(i, j)`` is asked only for pairs that the bounds
    allow and whose labels have not been joined yet."""
    label = np.unique(label, return_inverse=True)[1]
    short = signatures(bits, np.arange(len(bits)), TREE_BITS // 8)
    slack = sizes - np.bitwise_count(short).sum(axis=1).astype(np.int64)
    out: list[tuple[int, int]] = []

    def tried(i: int, j: int) -> None:
        if label[i] != label[j] and near(i, j):
            out.append((i, j))
            label[label == label[j]] = label[i]

    # Many members are near the first of a group; what it joins needs no further look within the group.
    open_ = np.argsort(sizes, kind="stable")
    for _ in range(16):
        if len(open_) < 2:
            break
        i, rest = open_[0], open_[1:]
        overlap = np.minimum(slack[i], slack[rest]) + np.bitwise_count(short[rest] & short[i]).sum(axis=1).astype(np.int64)
        for j in rest[((100 + percent) * overlap >= percent * (sizes[rest] + sizes[i])) & (label[rest] != label[i])].tolist():
            tried(i, j)
        open_ = rest[label[rest] != label[i]]
    for width, at, narrow in widths(bits, percent):
        if len(at) > 1 and (label[at] != label[at[0]]).any():
            tree = SignatureTree(sizes[at], signatures(bits, at, width), label[at], narrow)
            for a, b in tree.self_join(percent):
                a, b = at[a], at[b]
                keep = label[a] != label[b]
                for i, j in zip(a[keep].tolist(), b[keep].tolist(), strict=True):
                    tried(i, j)
    return out


def near_pairs(sets: list[np.ndarray], block: np.ndarray, across: bool, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of sets at the threshold, each pair once; with ``across`` only those of different blocks."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets, block = [sets[k] for k in order], block[order]
    n = np.array([len(x) for x in sets], np.int64)
    bits = [bitmap(x) for x in sets]
    stop = np.searchsorted(n, 100 * n // percent, side="right")
    right = [np.zeros(0, np.int64)] * len(n)
    for width, at, narrow in widths(bits, percent):
        # Sets are sorted by size, so those of this width come first.
        signature = signatures(bits, at, width)
        slack = n[at] - np.bitwise_count(signature).sum(axis=1).astype(np.int64)
        for k, i in enumerate(at[narrow].tolist()):
            j = np.arange(k + 1, stop[i] - i + k)
            if across:
                j = j[block[at[j]] != block[i]]
            most = np.minimum(slack[k], slack[j]) + np.bitwise_count(signature[j] & signature[k]).sum(axis=1).astype(np.int64)
            right[i] = at[j[(100 + percent) * most >= percent * (n[i] + n[at[j]])]]
    a, b = np.repeat(np.arange(len(n)), [len(x) for x in right]), np.concatenate(right)
    # Shingles that one set alone has are in no overlap; the others are columns of a bit table.
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    member, keep = np.repeat(np.arange(len(n)), n), times[at] > 1
    member, at = member[keep], (np.cumsum(times > 1) - 1)[at[keep]]
    common = np.zeros(len(a), np.int64)
    for low in range(0, int((times > 1).sum()) if len(a) else 0, COLUMNS):
        own = (at >= low) & (at < low + COLUMNS)
        held = np.zeros((len(n), -(-(int(at[own].max()) - low + 1) // 64) * 64), bool)
        held[member[own], at[own] - low] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for k in range(0, len(a), 1024):
            common[k : k + 1024] += np.bitwise_count(bits[a[k : k + 1024]] & bits[b[k : k + 1024]]).sum(axis=1).astype(np.int64)
    near = 100 * common >= percent * (n[a] + n[b] - common)
    return order[a[near]], order[b[near]]


def joining(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Which of the pairs join what the pairs before them leave apart; equal values of ``a`` stand together."""
    label, out = np.arange(size), []
    edge = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True]) if len(a) else np.zeros(1, np.int64)
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        i, open_ = a[low], np.arange(low, high)
        while len(open_ := open_[label[b[open_]] != label[i]]):
            out.append(open_[0])
            label[label == label[b[open_[0]]]] = label[i]
    return np.array(out, np.int64)


# ------------------------------------------------------------------------------------------------------ passes over text

_PROFILE = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def _digest(own: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _profile(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def frequent() -> pa.RecordBatch:
            value, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = times >= 4
            value, times = value[keep].view(np.int64), times[keep]
            none = pa.nulls(len(value), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(value), np.int32)), pa.array(value), none, none, pa.array(times), pa.nulls(len(value), pa.binary())], schema=_PROFILE)

        for batch in slices(batches, limit=SLICE):
            sets = shingle_sets(texts_of(batch), n_words)
            lo, hi = zip(*(_digest(x) for x in sets), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), column(batch, "doc_id"), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) if len(x) else None for x in sets], pa.binary())], schema=_PROFILE
            )
            values = flat(sets)[0]
            held.append(values)
            count += len(values)
            if count >= STRETCH:
                yield frequent()
                held, count = [], 0
        yield frequent()

    return run


def _prefixes(n_words: int, percent: int, known):
    """known: broadcast arrays of the frequent shingles, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = known.value
        seen: set[int] = set()
        for batch in slices(batches, limit=SLICE):
            out, own, sizes = [], [], []
            for x in shingle_sets(texts_of(batch), n_words):
                if not len(x) or (key := _digest(x)[0]) in seen:
                    continue
                seen.add(key)
                size = prefix_size(len(x), percent)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    hot = common[at] == x
                    if hot.any():
                        late = x[hot]
                        x = np.concatenate([x[~hot], late[np.lexsort((late, times[at[hot]]))]])
                out.append(x[:size])
                own.append(key)
                sizes.append(len(x))
            token, each = flat(out)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(np.repeat(np.array(own, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int64), each))], ["token", "lo", "n"])

    return run


def _groups(percent: int):
    """Sorted (token, n, lo) in; the rows of tokens that several sets have out, each with the first set of its size class.

    Only one row is carried from batch to batch, however long a group is."""
    ratio = np.log(100 / percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "lo", "n", "lead"]
        last = None  # token, lo, n, lead, linked
        for batch in batches:
            token, lo, n = (column(batch, x).to_numpy() for x in ("token", "lo", "n"))
            if not len(token):
                continue
            if last:
                token, lo, n = np.r_[last[0], token], np.r_[last[1], lo], np.r_[last[2], n]
            keep = np.r_[True, (token[1:] != token[:-1]) | (lo[1:] != lo[:-1])]
            token, lo, n = token[keep], lo[keep], n[keep]
            level = (np.log(n) / ratio).astype(np.int64)
            follows = token[1:] == token[:-1]
            first = np.r_[True, ~(follows & (level[1:] == level[:-1]))]
            lead = lo[np.maximum.accumulate(np.where(first, np.arange(len(lo)), 0))]
            if last:
                same = np.cumsum(first) == 1
                lead[same] = last[3]
            linked = np.r_[last[4] if last else False, follows]
            keep = (linked | np.r_[follows, False])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (token, lo, n, lead)], names)
            last = (token[-1], lo[-1], n[-1], lead[-1], bool(linked[-1]))
        if last and last[4]:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in last[:4]], names)

    return run


# --------------------------------------------------------------------------------------------------------------- joins


def _candidates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links u, v between the representatives of the pairs (a, b) of digests whose sizes and bitmaps allow the threshold."""

    def side(x: str) -> DataFrame:
        return classes.select(F.col("lo").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, x, y = (column(batch, c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            keep = pa.array([may_reach(p, q, n, m, percent) for p, q, n, m in zip(x, y, n_a, n_b, strict=True)], pa.bool_())
            yield batch.select(["rep_a", "rep_b"]).filter(keep).rename_columns(["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each key, of batches that are sorted by key, as lists by column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [column(batch, k).to_numpy() for k in keys]
        edge = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in arrays])) + 1
        for a, b in zip(np.r_[0, edge].tolist(), np.r_[edge, batch.num_rows].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if held and any(column(held[0], k)[0] != column(part, k)[0] for k in keys):
                yield {x: [v for h in held for v in column(h, x).to_pylist()] for x in names}
                held = []
            held.append(part)
    if held:
        yield {x: [v for h in held for v in column(h, x).to_pylist()] for x in names}


_LINKS = ["u", "v"]


def _links(rep: list[int], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([rep[i] for i, _ in pairs], pa.int64()), pa.array([rep[j] for _, j in pairs], pa.int64())], _LINKS)


def _candidate_join(percent: int):
    """Groups in, sorted by (token, i, j): rep, n, component, bits; candidate links that join components out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ["token", "i", "j"], ["rep", "n", "component", "bits"]):
            n, bits = rows["n"], rows["bits"]
            pairs = joining_pairs(np.array(n, np.int64), bits, np.array(rows["component"], np.int64), lambda i, j: may_reach(bits[i], bits[j], n[i], n[j], percent), percent)  # noqa: B023
            if pairs:
                yield _links(rows["rep"], pairs)

    return run


_FOUND = pa.schema([("lo", pa.int64()), ("n", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _exact_join(n_words: int, percent: int, all_pairs: bool = False):
    """Clusters in, sorted by (cluster, i, j): doc_id, lo, text, block, weight. Out: for each class with links (lo) the
    weights of those near it, and the links (u, v) that join components, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ["cluster", "i", "j"], ["i", "j", "doc_id", "lo", "text", "block", "weight"]):
            sets = shingle_sets(rows["text"], n_words)
            # Another text with the same id is not the one that stands for the class.
            own = {lo: k for k, (lo, x) in enumerate(zip(rows["lo"], sets, strict=True)) if len(x) and _digest(x)[0] == lo}
            if len(own) < 2:
                continue
            rep, block, weight = (np.array([rows[x][k] for k in own.values()], np.int64) for x in ("doc_id", "block", "weight"))
            a, b = near_pairs([sets[k] for k in own.values()], block, rows["i"][0] != rows["j"][0], percent)
            apart = rep[a] != rep[b]
            a, b = a[apart], b[apart]
            links = np.bincount(a, weight[b], len(rep)).astype(np.int64) + np.bincount(b, weight[a], len(rep)).astype(np.int64)
            has = np.flatnonzero(links)
            if len(has):
                lo, none = np.array(list(own), np.int64), pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(lo[has]), pa.array(links[has]), none, none], schema=_FOUND)
                given = slice(None) if all_pairs else joining(a, b, len(rep))
                u, v = rep[a[given]], rep[b[given]]
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(u), pa.array(v)], schema=_FOUND)

    return run


def _dealt(rows: DataFrame, key: str, blocks: DataFrame, member: str) -> DataFrame:
    """Rows with ``block``, ``i`` and ``j``: all of a small key's are 0; a large one's meet as pairs of hashed blocks, and a
    block's own rows as a pair with itself."""
    placed = rows.join(blocks, key).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")))
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    placed = placed.withColumn("p", F.explode(F.when(F.col("blocks") == 1, alone).otherwise(pair)))
    return placed.select(*rows.columns, "block", "p.i", "p.j")


# ------------------------------------------------------------------------------------------------------------- operator


def _joined(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int, all_pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The profile of each row, the classes, their weights (ids that have the set) and what the exact join finds."""
    spark = docs.sparkSession
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("doc_id is not null")
    made = stored(source.mapInArrow(_profile(n_words), "kind int, a long, b long, c long, n long, bits binary"), "profile")
    texts = made.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("lo"), F.col("c").alias("hi"), "n", "bits")

    least = max(FREQUENT_LEAST, FREQUENT * texts.count())
    hot = made.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    hot = hot.assign(a=hot["a"].to_numpy(np.int64).view(np.uint64)).sort_values("a")
    known = spark.sparkContext.broadcast((hot["a"].to_numpy(), hot["n"].to_numpy(np.int64)))

    token = source.mapInArrow(_prefixes(n_words, percent, known), "token long, lo long, n long")
    groups = stored(token.repartition("token").sortWithinPartitions("token", "n", "lo").mapInArrow(_groups(percent), "token long, lo long, n long, lead long"), "groups")
    classes = stored(texts.where("n > 0").groupBy("lo").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits")), "classes")

    star = groups.where("lo <> lead").select(F.col("lead").alias("a"), F.col("lo").alias("b")).distinct()
    early = components(_candidates(star, classes, percent))
    placed = classes.join(early, classes["rep"] == early["node"], "left").select("lo", "rep", "n", "bits", F.coalesce("component", "rep").alias("component"))

    at = groups.select("token", "lo").join(placed.select("lo", "component"), "lo")
    mixed = at.groupBy("token").agg(
        F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("lo").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("lo", F.lit(1))).alias("xor")
    ).where("low < high")
    once = mixed.groupBy("members", "sum", "xor").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    dealt = _dealt(groups.select("token", "lo"), "token", once, "lo").drop("block").join(placed, "lo")
    more = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_candidate_join(percent), "u long, v long")
    clusters = stored(components(early.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)), "clusters")

    sizes = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK).cast("int").alias("blocks")).withColumnRenamed("component", "cluster")
    weights = texts.where("n > 0").select("lo", "doc_id").distinct().groupBy("lo").agg(F.count(F.lit(1)).alias("weight"))
    member = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(classes.select("rep", "lo"), "rep").join(weights, "lo")
    wanted = stored(_dealt(member, "cluster", sizes, "rep").select(F.col("rep").alias("doc_id"), "lo", "weight", "cluster", "block", "i", "j"), "wanted")
    needed = source.where(possibly(wanted, "doc_id")(F.col("doc_id")))
    met = wanted.join(needed, "doc_id").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    found = stored(met.mapInArrow(_exact_join(n_words, percent, all_pairs), "lo long, n long, u long, v long"), "found")
    return texts, classes, weights, found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` (least id with the same set), ``component_id`` and ``n_links`` (other
    documents at the threshold, copies among them) of each row."""
    texts, classes, weights, found = _joined(docs, id_col, text_col, n_words, percent)
    last = components(found.where("u is not null").select("u", "v"))
    links = found.where("lo is not null").groupBy("lo").agg(F.sum("n").alias("links"))
    kind = (
        classes.join(last, classes["rep"] == last["node"], "left").select("lo", "rep", F.coalesce("component", "rep").alias("component"))
        .join(weights, "lo").join(links, "lo", "left").select("lo", "rep", "component", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    return texts.join(kind, "lo", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """``a`` < ``b``: all pairs of class representatives (``class_id``) at the threshold. The rows grow with the square of a
    cluster of different texts."""
    found = _joined(docs, id_col, text_col, n_words, percent, all_pairs=True)[3]
    return found.where("u is not null").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the least of their component, one of those with equal id and text (which one, where other
    columns differ, is not defined). Texts without words stay, and so do rows without id, which the join can't name."""
    keep = jaccard_components(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(keep, id_col, "left_semi")
    # Only the rows of ids that stand more than once are compared.
    several = kept.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(id_col)
    once = kept.join(several, id_col, "left_anti").unionByName(kept.join(several, id_col, "left_semi").dropDuplicates([id_col, text_col]))
    return once.unionByName(docs.where(docs[id_col].isNull()))
