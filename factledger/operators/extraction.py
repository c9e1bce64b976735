"""Claims read from notes by rules, and what the words beside a claim's value say about it.

Every number that is a figure makes a claim: its entity is the name (or total) that stands last before it, its metric and
period the words next to it. Column expressions only; the words of a line are met by its numbers in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import arrays
from factledger.functions import lexicons as lx
from factledger.operators.mentions import hedge, tokens
from factledger.operators.names import LINE

KEY = [*LINE, "claim_idx"]


def _nearest(text: Column, last: bool) -> Column:
    """The metric whose word stands last in the text, or first; null for none."""
    found = []
    for name, pattern in lx.METRICS.items():
        at = F.char_length(F.regexp_extract(text, rf"(?s)^(.*)(?:{pattern})", 1)) if last else -F.regexp_instr(text, F.lit(pattern))
        found.append(F.when(text.rlike(pattern), F.struct(at.alias("at"), F.lit(name).alias("name"))))
    return F.array_max(F.array(*found))["name"]


def _period(near: Column, before: Column, otherwise: Column) -> Column:
    out = F.when(F.lit(False), "")
    for text in (near, before):
        for name, pattern in lx.PERIODS.items():
            out = out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


def regex_claims(mentions: DataFrame, lines: DataFrame, spans: DataFrame) -> DataFrame:
    """``note_id``, ``table_id``, ``line_idx``, ``claim_idx``, ``entity``, ``metric``, ``period``, ``value_text``,
    ``direction``, ``qualifier``. ``mentions`` with what level 1 found to be no figure marked; ``spans`` as of
    ``names.entity_spans``. A line that names nothing gives claims about an empty name."""
    totals = lines.select(*LINE, F.explode(arrays.spans(F.lower("line"), F.lit(r"\b(?:total|overall)\b"))).alias("s")).select(*LINE, F.lit("TOTAL").alias("entity"), "s.start", "s.end")
    marks = spans.select(*LINE, "entity", "start", "end").unionByName(totals).groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("start", "end", "entity"))).alias("marks"))
    line = Window.partitionBy(*LINE).orderBy("mention_idx")
    m = mentions.where("skip_reason = ''").select(*LINE, "table_id", "mention_idx", "line", "raw_text", "position", "unit", "is_rank", "direction").join(marks, LINE, "left")
    stop = F.col("position") + F.char_length("raw_text")
    m = m.withColumn("stop", stop).withColumn("prev", F.coalesce(F.lag("stop").over(line), F.lit(0)))
    behind = F.filter("marks", lambda x: x["end"] <= F.col("position"))
    m = m.withColumn("behind", F.get(behind, F.size(behind) - 1))
    begin = F.greatest("prev", F.coalesce("behind.end", F.lit(0)))
    low = F.lower("line")
    m = m.select("*", low.substr(begin + 1, F.greatest(F.col("position") - begin, F.lit(0))).alias("before"), low.substr(F.col("stop") + 1, F.lit(30)).alias("after"))
    word = F.coalesce(_nearest(F.col("before"), True), _nearest(F.get(F.split("after", r"[,;(]|\d"), F.lit(0)), False))
    own = F.when(F.col("is_rank"), "rank").when(F.col("unit") == "currency", "revenue").otherwise(F.when(word == "rank", "revenue").otherwise(word))
    m = m.withColumn("own", own)
    # Without a word of its own a number goes on with what the number before it was about; a rank is not gone on with.
    carried = F.last("own", True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("metric", F.coalesce("own", F.when(carried == "rank", "revenue").otherwise(carried), F.lit("revenue")))
    near = F.array_join(F.slice(F.filter(F.split("after", r"\s+"), lambda x: x != ""), 1, 2), " ")
    period = F.when(F.col("metric").isin("rank", "share"), "TW").otherwise(_period(near, F.col("before"), F.when((F.col("unit") == "percent") | (F.col("direction") != "none"), "WoW").otherwise("TW")))
    number = F.row_number().over(Window.partitionBy("note_id").orderBy("line_idx", "mention_idx")) - 1
    return m.select(
        "note_id", "table_id", "line_idx", number.alias("claim_idx"), F.coalesce("behind.entity", F.get("marks", F.lit(0))["entity"], F.lit("")).alias("entity"), "metric", period.alias("period"),
        F.col("raw_text").alias("value_text"), "direction", F.lit("none").alias("qualifier"),
    )


def with_occurrence(claims: DataFrame) -> DataFrame:
    """``occurrence``: how many claims of the line before it have the same value text."""
    return claims.withColumn("occurrence", F.row_number().over(Window.partitionBy(*LINE, "value_text").orderBy("claim_idx")) - 1)


def text_hints(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Claims with ``h_qualifier``, ``h_change``, ``h_period``, ``h_metric``: what stands next to the value in its line, null
    where nothing does. A value is looked for where it stands alone; the n-th claim of a value is its n-th place."""
    c = with_occurrence(claims).join(lines.select(*LINE, "line"), LINE, "left")
    value = F.trim("value_text")
    pattern = F.concat(F.lit(r"(?<![\d.,])\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\d|[.,]\d)"))
    c = c.withColumn("at", F.when((value != "") & F.col("line").isNotNull(), arrays.spans(F.col("line"), pattern)))
    place = F.get("at", F.least(F.col("occurrence"), F.size("at") - 1))
    c = c.withColumn("pre", F.col("line").substr(F.lit(1), place["start"])).withColumn("post", F.col("line").substr(place["end"] + 1, F.char_length("line")))
    before = F.slice(F.concat(F.array().cast("array<string>"), tokens(F.col("pre"), r"[#\w.'-]+|[£$€~]")), F.greatest(F.size(tokens(F.col("pre"), r"[#\w.'-]+|[£$€~]")) - 3, F.lit(1)), F.lit(4))
    after = F.slice(F.transform(tokens(F.col("post"), r"[#\w.'-]+"), lambda w: F.rtrim(w, F.lit("."))), 1, 3)
    c = c.withColumn("b", before).withColumn("a", after)
    last, first, second = F.get("b", F.size("b") - 1), F.get("a", F.lit(0)), F.get("a", F.lit(1))
    level = F.coalesce(last.isin(lx.TO_LEVEL), F.lit(False))
    told = F.filter("b", lambda w: ~w.isin(lx.PASSED_OVER))
    noun = F.coalesce(F.get(told, F.size(told) - 1).isin(lx.CHANGE_NOUNS), F.lit(False)) & ~level
    versus = first.isin(lx.COMPARE_WORDS) & second.isin("lw", "ly") & ~level & ~F.coalesce(F.get("a", F.lit(2)).rlike(r"^[£$€\d]"), F.lit(False))
    change = F.when(versus, F.when(second == "lw", "WoW").otherwise("YoY")).when(noun, F.when(F.arrays_overlap("a", F.array(*map(F.lit, lx.LAST_YEAR))), "YoY").otherwise("WoW"))
    label = F.create_map(*[F.lit(x) for pair in lx.PERIOD_LABELS.items() for x in pair])
    period = F.when(label[first].isNotNull() & F.col("post").rlike(r"^\s+\w"), label[first]).otherwise(F.nullif(F.regexp_extract("pre", r"\b(TW|LW|LY)\s*:?\s*$", 1), F.lit("")))
    metric = F.when(first.rlike("^units?$"), "units").when(first.rlike("^(orders?|invoices?)$"), "orders").when(first == "share", "share")
    return c.select(*claims.columns, hedge(F.col("pre")).alias("h_qualifier"), change.alias("h_change"), period.alias("h_period"), metric.alias("h_metric"))


def hinted(claims: DataFrame, lines: DataFrame, units: DataFrame) -> DataFrame:
    """Claims after the words beside their values have corrected period, metric and hedge, and ``adjusted``: what was
    changed. ``units`` has the key, ``unit`` and ``is_ratio`` of each value."""
    c = text_hints(claims, lines).join(units, KEY, "left")
    unit, ratio = F.coalesce("unit", F.lit("plain")), F.coalesce("is_ratio", F.lit(False))
    plain = F.upper(F.regexp_replace(F.coalesce(F.nullif(F.trim("period"), F.lit("")), F.lit("TW")), "[- ]", ""))
    said = F.when(plain.isin("WOW", "WEEKONWEEK"), "WoW").when(plain.isin("YOY", "YEARONYEAR"), "YoY").otherwise(plain)
    q = (F.col("h_qualifier") != "none") & F.coalesce("qualifier", F.lit("none")).isin("", "none")
    worded = F.col("h_period").isNull() & F.col("h_change").isNotNull() & unit.isin("currency", "count") & said.isin("TW", "LW", "LY")
    now = F.when(worded, F.col("h_change")).otherwise(said)
    is_level = F.col("h_period").isin("TW", "LW", "LY")
    by_label = ~ratio & F.col("h_period").isNotNull() & (F.col("h_period") != now) & (is_level & (unit != "percent") | ~is_level & (unit == "percent"))
    m = F.col("h_metric").isNotNull() & (F.col("h_metric") != F.lower(F.coalesce("metric", F.lit("")))) & ~((F.col("h_metric") == "share") & (unit != "percent"))
    to = lambda a, b: F.concat(a, F.lit("->"), b)
    notes = F.array(
        F.when(q, F.concat(F.lit("hedge '"), "h_qualifier", F.lit("' from text"))), F.when(worded, F.concat(F.lit("period "), to(said, F.col("h_change")), F.lit(" from change wording"))),
        F.when(by_label, F.concat(F.lit("period "), to(now, F.col("h_period")), F.lit(" from text"))), F.when(m, F.concat(F.lit("metric "), to(F.coalesce("metric", F.lit("")), F.col("h_metric")), F.lit(" from text"))),
    )
    new = {
        "period": F.when(by_label, F.col("h_period")).when(worded, F.col("h_change")).otherwise(F.col("period")), "metric": F.when(m, F.col("h_metric")).otherwise(F.col("metric")),
        "qualifier": F.when(q, F.col("h_qualifier")).otherwise(F.col("qualifier")),
    }
    return c.select(*[new[x].alias(x) if x in new else F.col(x) for x in claims.columns], F.array_join(F.filter(notes, lambda x: x.isNotNull()), "; ").alias("adjusted"))
