"""Likeness of texts by their longest common subsequence, as column functions.

``ratio`` is 200 * common / (length + length): 100 for equal texts, and 100 less the share of letters to take out and put
in otherwise. ``partial_ratio`` is the best ratio of the shorter text and a stretch of the longer one that is as long (or
cut off by an end of it). The token forms compare texts by their words: in alphabetical order, or what they share against
what each has besides. ``weighted_ratio`` is the best of these, each by its weight; the weights hang on how unlike the
lengths are.

The length of the longest common subsequence is found bit-parallel: one bit for each letter of the first text, and for
each letter of the second an addition and three logical operations (Hyyrö's form), so a pair costs as many steps as the
second text has letters. A text of more than ``BITS`` letters is split into blocks that hand on their carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factledger.functions.arrays import let

BITS = 60  # letters in a block; sums of two blocks fit a long
FULL = (1 << BITS) - 1


def letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def masks(text: Column) -> Column:
    """Of each letter of the text, where it stands: one long for each block of ``BITS`` letters."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def of(every: Column, letter: Column) -> Column:
        """A long a block; a block's bits are summed, each once."""
        block = lambda b: F.aggregate(F.transform(F.slice(every, b * BITS + 1, F.lit(BITS)), lambda c, i: F.when(c == letter, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BITS).cast("int")), block)

    made = lambda every: let(F.array_distinct(every), lambda keys: F.map_from_arrays(keys, F.transform(keys, lambda c: of(every, c))))
    return F.when(F.char_length(text) > 0, let(letters(text), made)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<bigint>>")))


def common(known: Column, other: Column) -> Column:
    """The length of the longest common subsequence of the text whose ``masks`` are known and another one."""
    return let(known, lambda m: _common(m, other))


def _common(known: Column, other: Column) -> Column:
    size = F.size(F.get(F.map_values(known), F.lit(0)))
    full = F.lit(FULL)

    def block(v: Column, m: Column, carry: Column) -> Column:
        """The block's new bits below, the next block's carry above."""
        return let(v.bitwiseAND(m), lambda u: (v + u + carry).bitwiseOR(v - u))

    def one(v: Column, letter: Column) -> Column:
        single = let(F.get(F.try_element_at(known, letter), F.lit(0)), lambda m: F.array(block(F.get(v, F.lit(0)), m, F.lit(0).cast("long")).bitwiseAND(full)))
        zero = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("carry"))

        def along(acc: Column, x: Column) -> Column:
            u = x["v"].bitwiseAND(x["m"])
            total = x["v"] + u + acc["carry"]
            return F.struct(F.concat(acc["done"], F.array(total.bitwiseOR(x["v"] - u).bitwiseAND(full))).alias("done"), F.shiftright(total, BITS).alias("carry"))

        # Several blocks: one after the other, each with the carry of the one before.
        several = F.aggregate(F.zip_with(v, F.try_element_at(known, letter), lambda a, b: F.struct(a.alias("v"), b.alias("m"))), zero, along)["done"]
        return F.when(~F.map_contains_key(known, letter), v).when(F.size(v) == 1, single).otherwise(several)

    def counted(n: Column) -> Column:
        last = F.aggregate(letters(other), F.transform(F.sequence(F.lit(1), n), lambda _: full), one)
        return F.aggregate(last, F.lit(0), lambda a, v: a + (F.lit(BITS) - F.bit_count(v)))  # a cleared bit is in the subsequence

    return F.when(size > 0, let(size, counted)).otherwise(F.lit(0))


def ratio(a: Column, b: Column, known: Column | None = None) -> Column:
    """Of two texts; ``known``: the masks of the first, where they are at hand. Two empty texts are equal."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total > 0, 200 * common(masks(a) if known is None else known, b) / total).otherwise(F.lit(100.0))


def best_window(known: Column, size: Column, text: Column, starts: Column) -> Column:
    """Of the stretches of ``size`` letters that begin at ``starts`` (below 0 and beyond the last they are cut off by the
    text's end) the one most like the text whose masks are known: ``score``, ``start``, ``end``. The first of equals."""
    n = F.char_length(text)

    def scored(known: Column, s: Column) -> Column:
        a, b = F.greatest(s, F.lit(0)), F.least(s + size, n)
        return F.struct((200 * _common(known, F.substring(text, a + 1, b - a)) / (size + b - a)).alias("score"), (-a).alias("earlier"), a.alias("start"), b.alias("end"))

    able = F.filter(starts, lambda s: (s < n) & (s + size > 0))
    return let(known, lambda m: F.array_max(F.transform(able, lambda s: scored(m, s))))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best ratio of the shorter text and a stretch of the longer one; 0 if only one of them is empty."""
    swap = F.char_length(a) > F.char_length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    m, n = F.char_length(short), F.char_length(long)
    best = best_window(masks(short), m, long, F.sequence(1 - m, n - 1))["score"]
    same = F.when(m == n, 200 * common(masks(long), short) / (m + n))  # by either side of equal lengths
    return F.when(n == 0, 100.0).when(m == 0, 0.0).otherwise(F.greatest(best, same))


def words(text: Column) -> Column:
    """The words between white space in alphabetical order, each once."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != "")))


def _sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(_sorted(a), _sorted(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """100 where one has all words of the other; else the best ratio of the shared words, and these with the rest of each."""
    wa, wb = words(a), words(b)
    shared = F.array_join(F.array_intersect(wa, wb), " ")
    more = lambda x, y: F.array_join(F.array_except(x, y), " ")
    rest_a, rest_b = more(wa, wb), more(wb, wa)
    gap = F.when(shared != "", F.lit(" ")).otherwise(F.lit(""))
    left, right = F.concat(shared, gap, rest_a), F.concat(shared, gap, rest_b)
    n = F.char_length(shared)
    alone = lambda x: F.when(n > 0, 200 * n / (n + F.char_length(x))).otherwise(0.0)
    either = F.greatest(ratio(left, right), alone(left), alone(right))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).when((shared != "") & ((rest_a == "") | (rest_b == "")), 100.0).otherwise(either)


def partial_token_ratio(a: Column, b: Column) -> Column:
    """100 where a word is shared, else the best partial ratio of the words in order."""
    return F.when(F.size(F.array_intersect(words(a), words(b))) > 0, 100.0).otherwise(partial_ratio(_sorted(a), _sorted(b)))


# Weights of the token forms and of the partial ones, and where the lengths are too unlike for whole texts.
TOKEN, PARTIAL, FAR_PARTIAL, UNLIKE, FAR = 0.95, 0.9, 0.6, 1.5, 8.0


def weighted_ratio(a: Column, b: Column) -> Column:
    """The best of the ratios, by their weights; 0 if one of the texts is empty."""
    m, n = F.char_length(a), F.char_length(b)
    unlike = F.greatest(m, n) / F.least(m, n)
    scale = F.when(unlike <= FAR, PARTIAL).otherwise(FAR_PARTIAL)
    whole = F.greatest(ratio(a, b), TOKEN * F.greatest(token_sort_ratio(a, b), token_set_ratio(a, b)))
    part = F.greatest(ratio(a, b), scale * partial_ratio(a, b), TOKEN * scale * partial_token_ratio(a, b))
    return F.when((m == 0) | (n == 0), 0.0).when(unlike < UNLIKE, whole).otherwise(part)
