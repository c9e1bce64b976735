"""Spans that overlap, by an equi-join on cells instead of every pair of a key.

Two spans overlap where one begins within the other, so each pair is found once: by the right span's cells and the left
one's start, or the other way round where the right span starts later. A span of up to 4^k places stands in the one or two
cells of that width that it touches; a start looks once at each width that the other side has. A span thus meets those that
overlap it and a few near them, however many its key has, and however long single spans are; and since cells are part of the
join's key, a key that holds most spans is spread over the cluster.

Keys of few spans need no cells: their spans meet by the key alone, and where both sides already lie by key nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.sources.scratch import stored

FEW = 64  # spans of a key on either side up to which all its pairs are compared
STEP = 2  # widths are powers of 2^STEP


def _shift(x: Column, level: Column) -> Column:
    """The cell of place x at that level; shifting rounds down, below zero too."""
    return F.call_function("shiftright", x, (level * STEP).cast("int"))


def _level(start: Column, end: Column) -> Column:
    """The least level whose width holds the span: found from the number of binary digits of its length less one."""
    digits = F.length(F.bin(end - start - 1))
    return F.when(end - start <= 1, 0).otherwise(F.ceil(digits / STEP)).cast("int")


def compared(points: DataFrame, spans: DataFrame, keys: list[str], p: str, s: str) -> DataFrame:
    """The pairs in which the point span (prefix p) starts in a cell of the other (prefix s)."""
    cells = spans.withColumn("__level", _level(F.col(f"{s}_start"), F.col(f"{s}_end")))
    first, last = _shift(F.col(f"{s}_start"), F.col("__level")), _shift(F.col(f"{s}_end") - 1, F.col("__level"))
    cells = cells.withColumn("__cell", F.explode(F.sequence(first, last)))
    widths = spans.agg(F.collect_set(_level(F.col(f"{s}_start"), F.col(f"{s}_end"))).alias("__levels"))  # one row of at most 33 numbers
    looks = points.crossJoin(F.broadcast(widths)).withColumn("__level", F.explode("__levels")).drop("__levels")
    looks = looks.withColumn("__cell", _shift(F.col(f"{p}_start"), F.col("__level")))
    return looks.join(cells, [*keys, "__level", "__cell"]).drop("__level", "__cell")


def _placed(df: DataFrame, x: str) -> DataFrame:
    return df.withColumns({f"{x}_start": F.col(f"{x}_start").cast("long"), f"{x}_end": F.col(f"{x}_end").cast("long")}).where(f"{x}_start < {x}_end")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each pair of a left span (``l_start``, ``l_end``) and a right one (``r_start``, ``r_end``) of the same keys that share a
    place, with ``overlap``, the number of places. Ends are exclusive. Spans of no length and null places or keys meet
    nothing; places lie within 2^60 of 0; rows that repeat meet as often as they are there. Other columns go along; the two sides share the keys' names alone."""
    one, two = _placed(left, "l"), _placed(right, "r")
    found = compared(one, two, keys, "l", "r").where("l_start >= r_start and l_start < r_end")
    later = compared(two, one, keys, "r", "l").where("r_start > l_start and r_start < l_end")
    found = found.unionByName(later.select(*found.columns))
    return found.withColumn("overlap", F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """For each left span ``l_id`` of a key, the right span ``r_id`` that overlaps it most (ties: the earlier start, then id). Pairs are
    aggregated before they are shuffled, so a left span that meets many is no hot group.

    Keys of more than ``FEW`` spans on a side meet by cells, the others by key. ``sizes``: the keys with ``n``, at least the number of
    spans that they have on either side; without it spans are counted."""
    if sizes is None:
        sizes = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    many = stored(sizes.where(F.col("n") > FEW).select(*keys), "many")
    one, two = _placed(left, "l"), _placed(right, "r")
    overlap = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    if many.isEmpty():
        return _best(one.join(two, keys).withColumn("overlap", overlap).where("overlap > 0"), keys)
    few = one.join(many, keys, "left_anti").join(two, keys).withColumn("overlap", overlap).where("overlap > 0")
    hot = overlapping(left.join(many, keys, "left_semi"), right.join(many, keys, "left_semi"), keys)
    return _best(few, keys).unionByName(_best(hot.select(*few.columns), keys))


def _best(pairs: DataFrame, keys: list[str]) -> DataFrame:
    by = F.struct((-F.col("overlap")).alias("o"), F.col("r_start"), F.col("r_id"), F.col("l_start"))
    rest = F.struct(*[c for c in pairs.columns if c not in (*keys, "l_id")])
    best = pairs.groupBy(*keys, "l_id").agg(F.min_by(rest, by).alias("__best"))
    return best.select(*keys, "l_id", "__best.*").select(*pairs.columns)
