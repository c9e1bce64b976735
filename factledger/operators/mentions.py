"""Numbers cited in notes, with unit, precision, sign, hedge and the reason to skip those that aren't figures.

Only Column functions: a note is exploded into lines, sentences and matches, and each rule is an expression over the text
before and after the match. A line's place is its number among the lines that aren't blank."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factledger.functions import lexicons as lx
from factledger.functions.arrays import MARK, OTHER, let, marked, matched, running

REACH = 400  # characters on either side of a number that rules look at
BLOCK = 1024  # characters of a line whose dates are looked up together
SHORT = 64  # characters in which the nearest words are looked for first
CLAUSE_END = r"[,;:()]|\band\b|\bwhile\b|\bbut\b|\bwhereas\b"


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?U)({pattern})"), F.lit(1))


def _last(text: Column, n: int, words: Callable[[Column], Column]) -> Column:
    """Words of a text of which the last n are those of the whole. A stretch at its end has them where it has more: only its first word
    may have been cut."""
    near = words(F.substring(text, -SHORT, SHORT))
    return let(near, lambda x: F.when((F.size(x) > n) | (F.char_length(text) <= SHORT), x).otherwise(words(text)))


def _first(text: Column, n: int, words: Callable[[Column], Column]) -> Column:
    """Words of a text of which the first n are those of the whole."""
    near = words(F.substring(text, 1, SHORT))
    return let(near, lambda x: F.when((F.size(x) > n) | (F.char_length(text) <= SHORT), x).otherwise(words(text)))


def note_lines(notes: DataFrame) -> DataFrame:
    """``note_id``, ``table_id``, ``line_idx``, ``line``."""
    kept = F.filter(F.split("note", r"\r?\n"), lambda x: F.trim(x) != "")
    return notes.select("note_id", "table_id", F.posexplode(kept).alias("line_idx", "line"))


def _clause_words(pre: Column) -> Column:
    """The words of the clause that a text ends in; the last four are told."""
    return _last(pre, 4, lambda x: tokens(F.regexp_replace(x, rf"(?s)^.*(?:{CLAUSE_END})", ""), r"[\w'-]+"))


def _direction(words: Column) -> Column:
    """up, down or none: from the last three words of the clause before, nearest first."""
    size = F.size(words)

    def step(k: int, otherwise: Column | str) -> Column:
        w, p = F.get(words, size - 1 - k), F.coalesce(F.get(words, size - 2 - k), F.lit(""))
        made = (w == "up") & p.isin(lx.MAKE_WORDS)
        return (
            F.when(w.isNull() | w.isin(lx.LEVEL_WORDS), "none").when((w == "up") & p.isin(lx.GIVE_WORDS), "down").when(w.isin(lx.UP_WORDS) & ~made, "up").when(w.isin(lx.DOWN_WORDS), "down")
            .when(w.rlike(r"^\d[\d,.]*$"), "none").otherwise(otherwise)
        )

    return step(0, step(1, step(2, "none")))


def _behind(after: Column) -> Column:
    """up, down or none: from the words after, without those that name a period."""
    first, second = F.get(after, F.lit(0)), F.get(after, F.lit(1))
    nouns = lambda words: [w for w in words if w not in ("up", "down", "added", "lost")]
    return (
        F.when(first.isin("above", "ahead"), "up").when(first.isin("below", "behind"), "down").when(first.isin(nouns(lx.UP_WORDS)), "up").when(first.isin(nouns(lx.DOWN_WORDS)), "down")
        .when(first.isin("up", "down") & second.isin(lx.COMPARE_WORDS), first).otherwise("none")
    )


def _hedge_words(pre: Column) -> Column:
    """The last three words of a text, each after a space."""
    last = _last(pre, 3, lambda x: tokens(x, r"[\w.'~-]+|~"))
    return F.concat(F.lit(" "), F.array_join(F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), last), -3, 3), " "))


def _hedge(tail: Column) -> Column:
    out = F.when(tail.endswith("~"), "approx")
    for kind, phrases in lx.HEDGES.items():
        out = out.when(tail.rlike(rf" (?:{'|'.join(map(re.escape, phrases))})\z"), kind)
    return out.otherwise("none")


def hedge(pre: Column) -> Column:
    return let(_hedge_words(pre), _hedge)


def _words_before(pre: Column) -> Column:
    """The words of a text; the last two are told."""
    return _last(pre, 2, lambda x: tokens(x, r"[#\w.'-]+|[£$€~]"))


def _ranked(ending: Column, last: Column, pre: Column) -> Column:
    """Whether a number is a rank by its ending or the word before it."""
    return (ending != "") | last.isin("#", "no.", "no#", "rank", "ranked", "ranks", "ranking") | pre.endswith("#")


def _near_dates(dates: Column, size: Column) -> Column:
    """The dates by the blocks of the line that they touch, so that a number only looks at those about it."""
    blocks = F.sequence(F.lit(0), F.floor(size / BLOCK).cast("int"))
    return F.when(F.size(dates) > 0, F.transform(blocks, lambda b: F.filter(dates, lambda d: (d["start"] < (b + 1) * BLOCK) & (d["end"] > b * BLOCK))))


def _sentences(parts: Column) -> Column:
    """``text`` and ``offset`` of the sentences with a digit, from sentences and what stands between them in turn. A sentence's place is the
    length of all that stands before it, since the same sentence may stand twice."""
    one = lambda ends: lambda x, i: F.when((i % 2 == 0) & x.rlike(r"(?U)\d"), F.struct(x.alias("text"), (F.get(ends, i) - F.char_length(x)).alias("offset")))
    return let(running(F.transform(parts, lambda x: F.char_length(x))), lambda ends: F.filter(F.transform(parts, one(ends)), lambda x: x.isNotNull()))


def _numbers(part: Column, dates: Column) -> Column:
    """The numbers of a sentence, each with what stands before and after it as far as rules look, and what parts it from the
    number before."""
    text = part["text"]

    def one(m: Column, k: Column, all_: Column) -> Column:
        last = F.get(all_, k - 1)
        start, end = part["offset"] + m["start"], part["offset"] + m["end"]
        block = lambda at: F.exists(F.get(dates, F.floor(at / BLOCK).cast("int")), lambda d: (start < d["end"]) & (end > d["start"]))
        gap = F.when((k > 0) & (m["start"] - last["end"] <= REACH), F.substring(text, last["end"] + 1, m["start"] - last["end"]))
        pre = F.substring(text, F.greatest(m["start"] - REACH, F.lit(0)) + 1, F.least(m["start"], F.lit(REACH)))
        return F.struct(
            part["offset"].alias("offset"), F.char_length(text).alias("size"), m["start"].alias("start"), m["end"].alias("end"), m["raw"].alias("raw"),
            F.coalesce(dates.isNotNull() & (block(start) | block(end - 1)), F.lit(False)).alias("dated"), pre.alias("pre"), F.substring(text, m["end"] + 1, F.lit(REACH)).alias("post"), gap.alias("gap"), F.when(k > 0, last["raw"]).alias("last_raw"),
            F.when(k > 0, F.substring(text, F.greatest(last["start"] - REACH, F.lit(0)) + 1, F.least(last["start"], F.lit(REACH)))).alias("last_pre"),
        )

    return let(matched(marked(text, lx.NUMBER)), lambda found: F.transform(found, lambda m, k: one(m, k, found)))


def mentions(lines: DataFrame) -> DataFrame:
    """One row a number of each line; ``sentence`` and ``position`` are in the line as it was written.

    A line is worked on as a whole in one row: its sentences, their numbers, and for each number the ``REACH`` characters on
    either side that rules can look at. So the work grows with the length of a line, however many numbers it has, and
    nothing is shuffled."""
    # Equal lengths, so that places hold: "No.3" is a rank, "c.£4k" is about.
    norm = F.regexp_replace("line", r"(?i)\b(No)\.(?=\d)", "$1#")
    for word in ("approx", "ca", "c"):
        norm = F.regexp_replace(norm, rf"(?i)\b{word}\.(?=\s?[£$€\d])", "~" + " " * len(word))
    # A line without a digit has no number, and most lines are such. Places are found by a mark, which thus must not be in the text. No rule tells it from the letter that takes its place.
    norm = F.replace(norm, F.lit(MARK), F.lit(OTHER))
    texts = lines.where(F.col("line").rlike(r"(?U)\d")).select(*lines.columns, norm.alias("norm"))
    dates = let(matched(marked(F.col("norm"), lx.DATE)), lambda d: _near_dates(d, F.char_length("norm")))
    cut = texts.select(*lines.columns, marked(F.col("norm"), lx.SENTENCE_END).alias("parts"), dates.alias("dates"))
    every = F.flatten(F.transform(_sentences(F.col("parts")), lambda p: _numbers(p, F.col("dates"))))
    found = cut.select(*lines.columns, F.posexplode(every).alias("mention_idx", "m")).select(*lines.columns, "mention_idx", "m", "m.offset", "m.pre", "m.post")
    # Each of these is a column, so that it is worked out once: the number's groups, the words before and after it.
    groups = F.split(F.regexp_replace("m.raw", f"(?s)^{lx.NUMBER}.*$", MARK.join(f"${k}" for k in range(1, 8))), MARK, -1)
    after = _first(F.col("post"), 4, lambda x: tokens(x, r"[#\w.'-]+"))
    found = found.select("*", groups.alias("groups"), _words_before(F.col("pre")).alias("before"), F.transform(F.slice(after, 1, 4), lambda w: F.rtrim(w, F.lit("."))).alias("after"), _clause_words(F.col("pre")).alias("clause"), _hedge_words(F.col("pre")).alias("hedge_words"))
    group = lambda n: F.get("groups", F.lit(n - 1))
    mult, unit_text = F.lower(F.trim(group(6))), F.lower(F.trim(group(7)))
    final = lambda words: F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))
    last = final(F.col("before"))
    found = found.select(
        "*", F.replace(group(4), F.lit(","), F.lit("")).alias("digits"), last.alias("b1"), F.filter("after", lambda w: ~w.isin(lx.PERIOD_TOKENS)).alias("told"), unit_text.alias("unit_text"), group(2).alias("cur"),
        F.concat(group(1), group(3)).substr(1, 1).alias("mark"),
        F.when(mult.isin("k", "thousand"), 1e3).when(mult.isin("m", "mn", "million"), 1e6).when(mult.isin("b", "bn", "billion"), 1e9).otherwise(1.0).alias("scale"),
        _ranked(group(5), last, F.col("pre")).alias("own_rank"), _direction(F.col("clause")).alias("direction_before"), _hedge(F.col("hedge_words")).alias("hedge"),
    )
    # "ranks 1 to 6": a number that only a joining word parts from a rank is a rank too.
    joins = F.coalesce(F.col("m.gap").rlike(r"^\s*(to|through|and|-|–)\s*$"), F.lit(False))
    before_last = _ranked(F.regexp_extract("m.last_raw", lx.NUMBER, 5), let(_words_before(F.col("m.last_pre")), final), F.col("m.last_pre"))
    found = found.withColumns({"is_rank": F.col("own_rank") | (joins & F.coalesce(before_last, F.lit(False))), "direction_after": _behind(F.col("told"))})
    ratio = F.col("unit_text").isin("x", "times") | F.col("unit_text").endswith("fold")
    counted = F.coalesce(F.get("after", F.lit(0)).rlike(f"^({lx.COUNT_NOUNS})$"), F.lit(False))
    unit = F.when((F.col("cur") != "") | F.col("unit_text").isin("gbp", "usd", "eur"), "currency").when(ratio, "plain").when(F.col("unit_text") != "", "percent").when(F.col("is_rank") | counted, "count").otherwise("plain")
    explicit = F.when(F.col("mark").isin("-", "−", "–"), -1).when(F.col("mark") == "+", 1).otherwise(0)
    found = found.withColumns({"is_ratio": ratio, "unit": unit, "explicit": explicit, "decimals": F.char_length(F.regexp_extract("digits", r"\.(\d+)$", 1))})
    direction = F.when((F.col("explicit") != 0) | F.col("is_rank"), "none").when(F.col("direction_before") != "none", F.col("direction_before")).otherwise(F.col("direction_after"))
    found = found.withColumn("direction", direction)
    sign = F.when(F.col("explicit") != 0, F.col("explicit")).when(F.col("direction") == "up", 1).when(F.col("direction") == "down", -1).otherwise(0)
    found = found.withColumn("sign", sign).withColumn("cited", F.col("digits").cast("double") * F.when(F.col("sign") == 0, 1).otherwise(F.col("sign")))
    tail = F.array_join(F.slice("after", 1, 4), " ")
    n = F.abs("cited")
    b2 = F.coalesce(F.get("before", F.size("before") - 2), F.lit(""))
    bare = F.col("unit").isin("plain", "count") & (F.col("decimals") == 0) & (F.col("scale") == 1) & ~F.col("is_rank") & ~F.col("is_ratio")
    counting = (
        F.col("b1").isin(lx.COUNTING_BEFORE) | tail.rlike(r"^(of|out of)( the)?( top| bottom)? \d") | ((F.col("b1") == "of") & b2.rlike(r"^\d+$")) | F.lower("pre").rlike(r"\d+\s+of the\s*$")
        | tail.rlike(rf"^((listed|shown|ranked|tracked|reported|other|remaining|named|trading|active) )?({lx.COUNTING_NOUNS})\b")
    )
    skip = F.when(F.col("m.dated"), "date_or_week").when(bare & ~F.contains(F.col("m.raw"), F.lit(",")) & n.between(1990, 2035) & (F.col("unit") == "plain"), "year").when(bare & (n <= 200) & counting, "counting").otherwise("")
    found = found.withColumn("position", F.col("offset") + F.col("m.start")).withColumn("skip_reason", skip)
    return found.select(
        "note_id", "table_id", "line_idx", "mention_idx", "line", F.substring("line", F.col("offset") + 1, F.col("m.size")).alias("sentence"), F.trim("m.raw").alias("raw_text"), (F.col("cited") * F.col("scale")).alias("value"), "cited", "decimals", "scale", "unit",
        (F.col("sign") != 0).alias("signed"), "direction", "is_rank", "is_ratio", F.col("hedge").alias("qualifier"), F.when(F.get("after", F.lit(0)).isin("tw", "lw", "ly"), F.get("after", F.lit(0))).otherwise("").alias("period_hint"),
        "position", (F.col("position") + F.char_length("m.raw")).alias("end"), "skip_reason",
    )
