"""What the gate's labels come to: alignment with claims and truth, outcomes, flags, overlays and counts.

A number is a row (note_id, line_idx, position, raw_text, label) and a claim a row (note_id, line_idx, claim_idx,
value_text, label); every function is joins, windows within a line or a group, and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = ["note_id", "line_idx"]
WRONG = ("Wrong_entity", "Wrong_metric", "Wrong_value", "Wrong_direction")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9.]", "")


def claim_numbers(numbers: DataFrame, claims: DataFrame, taken: Column | None = None) -> DataFrame:
    """Each claim's key with the ``position`` of the number that its value stands for; claims whose value is not in the
    line are left out.

    A claim looks for its text among the numbers of its line, and for its digits if the text is not there. The n-th claim
    for a text (or for digits) gets the n-th such number that is not ``taken``, and the first one when they run out."""
    taken = F.lit(False) if taken is None else taken
    one = lambda df, text, number, claim: df.select(*LINE, digits(F.col(text)).alias("d"), F.col(text).alias("text"), *number, claim.alias("claim"))
    idx = claims.schema["claim_idx"].dataType
    n = one(numbers, "raw_text", [F.col("position"), taken.alias("taken")], F.lit(None).cast(f"struct<claim_idx:{idx.simpleString()}>"))
    c = one(claims, "value_text", [F.lit(None).cast(numbers.schema["position"].dataType).alias("position"), F.lit(None).cast("boolean").alias("taken")], F.struct("claim_idx"))
    # Equal texts have equal digits, so all that may meet shares a line and digits: one shuffle, whose groups are then cut by text.
    rows = n.unionByName(c).dropna(subset=[*LINE, "text"]).repartition(*LINE, "d")
    texts = rows.groupBy(*LINE, "d", "text").agg(F.min("position").alias("first"), F.sort_array(F.collect_list(F.when(~F.col("taken"), F.col("position")))).alias("free"), F.sort_array(F.collect_list("claim")).alias("asks"))
    said, none = F.col("first").isNotNull(), F.array().cast(texts.schema["asks"].dataType)
    looks = texts.groupBy(*LINE, "d").agg(
        F.collect_list(F.when(said & (F.size("asks") > 0), F.struct("first", "free", "asks"))).alias("by_text"), F.min("first").alias("first"), F.sort_array(F.flatten(F.collect_list("free"))).alias("free"),
        F.sort_array(F.flatten(F.collect_list(F.when(~said, F.col("asks"))))).alias("asks"),
    )
    given = lambda x: F.transform(x["asks"], lambda c, k: F.struct(c["claim_idx"].alias("claim_idx"), F.coalesce(F.get(x["free"], k), x["first"]).alias("position")))
    rest = F.struct("first", "free", F.when((F.col("d") != "") & said, F.col("asks")).otherwise(none).alias("asks"))
    return looks.select(*LINE, F.explode(F.flatten(F.transform(F.concat("by_text", F.array(rest)), given))).alias("x")).select(*LINE, "x.claim_idx", "x.position")


def gate_flags(numbers: DataFrame, claims: DataFrame) -> DataFrame:
    """The numbers with ``flag``: unsupported at level 1, or the value of a claim that is wrong."""
    wrong = claims.where(F.col("label").startswith("Wrong_"))
    hit = claim_numbers(numbers, wrong, F.col("label") == "Unsupported").select(*LINE, "position").distinct().withColumn("claimed", F.lit(True))
    return numbers.join(hit, [*LINE, "position"], "left").withColumn("flag", ((F.col("label") == "Unsupported") | F.coalesce("claimed", F.lit(False))).cast("int")).drop("claimed")


def level1_outcome(truth: Column, label: Column) -> Column:
    """``truth`` is C (correct), W (wrong) or N (no measurement); a null label was not extracted."""
    gone = label.isNull() | (label == "Skipped")
    flagged = F.coalesce(label == "Unsupported", F.lit(False))
    return (
        F.when(truth == "C", F.when(flagged, "false_alarm").when(gone, "correct_not_extracted").otherwise("true_pass"))
        .when(truth == "W", F.when(flagged, "caught").when(gone, "wrong_not_extracted").otherwise("miss"))
        .otherwise(F.when(flagged, "nm_flagged").when(gone, "nm_skipped").otherwise("nm_supported"))
    )


def level2_outcome(truth: Column, label: Column) -> Column:
    err = label.startswith("Wrong")
    three = lambda bad, good, lost: F.when(err, bad).when(label == "Correct", good).otherwise(lost)
    return (
        F.when(truth == "Correct", three("false_alarm", "verified", "coverage_loss")).when(truth.isin(*WRONG), three("detected", "miss", "hidden"))
        .when(truth == "Group_correct", three("group_flagged", "group_verified", "group_coverage_loss")).when(truth == "Group_wrong", three("group_wrong_flagged", "group_wrong_missed", "group_wrong_hidden"))
        .when(truth == "Unverifiable", F.when(label == "Unverifiable", "unverifiable_ok").otherwise("unverifiable_mislabelled"))
    )


def with_gate_label(truth: DataFrame, labelled: DataFrame, key: list[str]) -> DataFrame:
    """Truth beside the gate's label, one row for each of both; a key that the gate lacks or has twice is an error."""
    once = labelled.groupBy(*key).agg(F.min("label").alias("gate_label"), F.count(F.lit(1)).alias("n"))
    both = truth.join(once, key, "left")
    fail = F.raise_error(F.concat(F.lit("not one label: "), F.concat_ws("/", *[F.col(k).cast("string") for k in key])))
    return both.withColumn("gate_label", F.when(F.coalesce("n", F.lit(0)) == 1, F.col("gate_label")).otherwise(fail.cast("string"))).drop("n")


def note_outcomes(rows: DataFrame) -> DataFrame:
    """For each note: whether a right claim was flagged, whether it has an error, and whether all its errors were flagged."""
    err, good = F.col("gate_label").startswith("Wrong"), F.col("truth").isin("Correct", "Group_correct")
    bad = F.col("truth").isin(*WRONG, "Group_wrong")
    return rows.groupBy("note_id").agg(F.bool_or(good & err).alias("false_flag"), F.bool_or(bad).alias("has_error"), F.bool_and(~bad | err).alias("all_errors_flagged"))


def crosstab(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of each value of ``a`` by the values of ``b``, 0 where there is none."""
    return rows.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0, values)


def worst_notes(notes: DataFrame, group: str, count: str, key: str) -> DataFrame:
    """The note of each group with the greatest count, among those that did not fail; ties by key."""
    pick = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(count), key))
    return notes.where("not failed").withColumn("pick", pick).where("pick = 1").select(group, key, count)


def primary(rows: DataFrame, pilot: DataFrame, key: str) -> DataFrame:
    """The rows of tables that are in no pilot."""
    return rows.join(pilot.select(key).distinct(), key, "left_anti")


def notes_with_error(rows: DataFrame, group: str) -> DataFrame:
    """For each group the notes and those with a confirmed error, as the greatest ``confirmed`` of a note says."""
    note = rows.groupBy(group, "note_id").agg(F.max("confirmed").alias("has"))
    return note.groupBy(group).agg(F.sum("has").alias("k"), F.count(F.lit(1)).alias("n"))


def substituted(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """The lines with what stands at each fix (``position``, ``end``, ``text``) replaced; fixes of a line don't overlap.

    Read from the last to the first, so that the places of the others hold."""
    by_line = fixes.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("position", "end", "text")), False).alias("fixes"))
    put = F.aggregate(F.col("fixes"), F.col("line"), lambda acc, x: F.overlay(acc, x["text"], x["position"] + 1, x["end"] - x["position"]))
    return lines.join(by_line, LINE, "left").withColumn("line", F.when(F.col("fixes").isNull(), F.col("line")).otherwise(put)).drop("fixes")


def highlighted(lines: DataFrame, flagged: DataFrame) -> DataFrame:
    """``note_id``, ``line_idx``, ``html``: the lines with flagged stretches (``position``, ``end``) marked, and the rest
    escaped. A stretch that begins inside the one before it is left out."""
    start = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))
    escaped = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    piece = lambda a, b: escaped(F.col("line").substr(a + 1, F.greatest(b - a, F.lit(0))))

    def step(acc: Column, x: Column) -> Column:
        marked = F.concat(acc["out"], piece(acc["at"], x["position"]), F.lit('<mark title="Unsupported">'), piece(x["position"], x["end"]), F.lit("</mark>"))
        return F.when(x["position"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), marked.alias("out")))

    spans = flagged.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct(F.col("position").cast("int").alias("position"), F.col("end").cast("int").alias("end")))).alias("spans"))
    both = lines.join(spans, LINE, "left").withColumn("acc", F.aggregate(F.coalesce("spans", F.array().cast("array<struct<position:int,end:int>>")), start, step))
    return both.select(*LINE, F.concat("acc.out", piece(F.col("acc.at"), F.char_length("line"))).alias("html"))


def version_overlay(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Numbers by whether an older and a newer version of the rules flag them."""
    flag = lambda c: (F.coalesce(F.col(c), F.lit("")) == "Unsupported").cast("int")
    both = old.select(*key, F.col("label").alias("old")).join(new.select(*key, F.col("label").alias("new")), key, "full")
    return both.groupBy(flag("old").alias("old_flag"), flag("new").alias("new_flag")).agg(F.count(F.lit(1)).alias("n"))


# What a reviewer's verdict is numbered.
REVIEW_CODES = {"correct": 1, "wrong": 2, "unclear": 3, "not_a_measurement": 4}


def review_overlay(numbers: DataFrame, verdicts: DataFrame, key: list[str]) -> DataFrame:
    """The numbers with the code of their review (``final``); 0 where there is none."""
    code = F.create_map(*[F.lit(x) for pair in REVIEW_CODES.items() for x in pair])
    return numbers.join(verdicts.select(*key, "final"), key, "left").withColumn("code", F.coalesce(code[F.col("final")], F.lit(0))).drop("final")


def same_as_draft(notes: DataFrame, keys: list[str], arm: str, final: str, draft: str) -> DataFrame:
    """How many final notes equal their draft (of the same keys) letter by letter, and how many have a refused call."""
    text = notes.where(F.col(arm) == draft).select(*keys, F.col("note").alias("draft"))
    rows = notes.where(F.col(arm) == final).join(text, keys, "left")
    refused = F.exists("calls", lambda c: c["stop_reason"] == "refusal")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("note").eqNullSafe(F.col("draft"))).alias("identical"), F.count_if(F.coalesce(refused, F.lit(False))).alias("refusals"))


def trace_totals(notes: DataFrame, key: str) -> DataFrame:
    """Calls, tokens, cost and time of each note, over its array ``calls``."""
    total = lambda f, kind: F.aggregate("calls", F.lit(0).cast(kind), lambda acc, c: (acc + c[f].cast(kind)).cast(kind))
    return notes.select(key, F.size("calls").alias("n_calls"), total("tokens_in", "long").alias("tokens_in"), total("tokens_out", "long").alias("tokens_out"), total("cost", "decimal(24,4)").cast("double").alias("cost"), total("latency", "decimal(24,4)").cast("double").alias("latency"))


def cause(evidence: Column, label: Column, entity: Column, period: Column, line: Column) -> Column:
    """Why a claim was flagged, by its evidence ("Entity.Column=x, claimed Column" or "... direction wrong ...") and text."""
    shown, said = F.regexp_extract(evidence, r"\.(\w+)=", 1), F.regexp_extract(evidence, r"claimed (\w+)", 1)
    noun = lambda x: F.regexp_extract(x, "^([A-Za-z]+)_", 1)
    counts = ("Units", "Orders")
    return (
        F.when(F.contains(evidence, F.lit("direction wrong")) & period.isin("TW", "LW", "LY"), "direction on a level").when((F.upper(entity) == "TOTAL") | (entity == ""), "group taken for the total")
        .when(shown.rlike("^(Revenue|Units|Orders)_(LW|LY|TW)$") & said.endswith("_Abs"), "level taken for a change").when(noun(shown).isin(*counts) & noun(said).isin(*counts) & (noun(shown) != noun(said)), "noun ignored")
        .when((label == "Wrong_entity") & F.contains(evidence, F.lit("belongs to")), "wrong entity of a list").when(F.lower(line).rlike(r"\b(family|combined|colourways|lines)\b"), "family bound to a member").otherwise("other")
    )
