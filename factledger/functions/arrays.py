"""Column functions over arrays that are worked out once and in linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64
MATCHES = "array<struct<start:int,end:int,raw:string>>"
MARK, OTHER = "\ue000", "\ue001"  # two letters for private use, of one length


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: inside the functions of arrays an expression is worked out each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """The sums of the numbers up to each place; summed block by block, so the work grows with their number and not with its
    square. Null for none."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))

    def placed(numbers: Column) -> Column:
        sums = F.transform(blocks, lambda b: total(F.slice(numbers, b * BLOCK + 1, F.lit(BLOCK))))
        starts = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        block = lambda i: F.floor(i / BLOCK).cast("int")
        return let(starts, lambda s: F.transform(numbers, lambda _, i: F.get(s, block(i)) + total(F.slice(numbers, block(i) * BLOCK + 1, i % BLOCK + 1))))

    # Few numbers are one block.
    few = lambda numbers: F.transform(numbers, lambda _, i: total(F.slice(numbers, F.lit(1), i + 1)))
    return let(numbers, lambda x: F.when(F.size(x) > BLOCK, placed(x)).when(F.size(x) > 0, few(x)))


def marked(text: Column, pattern: str | Column) -> Column:
    """A text without ``MARK`` in pieces: what stands before the first match of a pattern, the match, what stands before the next one and
    so on; one piece if there is none. Spark makes a pattern of a split anew for each row, but keeps that of a replacement."""
    return F.split(F.regexp_replace(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def matched(pieces: Column) -> Column:
    """``start`` (from 0), ``end`` and ``raw`` of each match in the pieces of ``marked``."""
    size = lambda x: running(F.transform(x, lambda p: F.char_length(p)))
    put = lambda x, ends: F.transform(F.sequence(F.lit(1), F.size(x) - 2, F.lit(2)), lambda i: F.struct(F.get(ends, i - 1).alias("start"), F.get(ends, i).alias("end"), F.get(x, i).alias("raw")))
    return let(pieces, lambda x: F.when(F.size(x) > 1, let(size(x), lambda ends: put(x, ends))).otherwise(F.array().cast(MATCHES)))


def spans(text: Column, pattern: str | Column) -> Column:
    """``start`` (from 0), ``end`` and ``raw`` of each match of a pattern: what split leaves between the matches tells their
    places."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast(MATCHES)
    size = lambda found, gaps: F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.char_length(m) + F.char_length(g))
    placed = lambda found, gaps: F.zip_with(found, running(size(found, gaps)), lambda raw, end: F.struct((end - F.char_length(raw)).alias("start"), end.alias("end"), raw.alias("raw")))
    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(both, lambda x: F.when(F.size(x["m"]) > 0, placed(x["m"], x["g"])).otherwise(none))
