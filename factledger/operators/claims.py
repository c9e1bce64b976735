"""Level 2 of the number gate: is each claim (entity, metric, period, value) bound to the right cell?

A claim meets its table's rows in a join; a row's virtual columns are a map, and the label is one CASE over conditions on
them, in the order of the rules. Names are resolved exactly, by alias, by words, or by likeness; a name that fits several
rows is tried against each, and one that only is like a row's is never said to be wrong. Claims about groups are held
against the values of groups, entities and the table that level 1 uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import lexicons as lx
from factledger.functions.matching import matches, unit_ok
from factledger.operators import gate
from factledger.operators.extraction import hinted, regex_claims
from factledger.operators.mentions import mentions, note_lines
from factledger.operators.names import entity_spans, fuzzy_rows
from factledger.sources.scratch import stored

# Names of the whole table and of groups, and columns that say the same thing rounded or exactly.
TOTAL_WORDS = ["total", "overall", "all countries", "all products", "all entities", "the business", "company", "portfolio", "all rows", "all markets"]
GROUP_WORDS = ["group", "others", "rest", "remaining", "top five", "top 5", "top three", "top 3", "top ten", "top 10"]
ALSO = {"Revenue_WoW_Pct": "WoW_Pct", "Revenue_YoY_Pct": "YoY_Pct", "Share_Pct": "Share_TW_Exact", "Share_WoW_Abs": "Share_WoW_Abs_Exact"}
KEY = ["note_id", "line_idx", "claim_idx"]


def _div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _measures(total: bool) -> dict[str, Column]:
    d = lambda c: F.col(c).cast("double")
    out = {c: d(c) for c in gate.LEVELS}
    for m in gate.MEASURES:
        a, b = d(f"{m}_TW"), d(f"{m}_LW")
        out |= {f"{m}_WoW_Abs": a - b, f"{m}_WoW_Pct": _div(a - b, b) * 100, f"{m}_WoW_Ratio": _div(a, b)}
    a, b = d("Revenue_TW"), d("Revenue_LY")
    out |= {"Revenue_YoY_Abs": a - b, "Revenue_YoY_Pct": F.when(b > 0, (a - b) / b * 100), "Revenue_YoY_Ratio": _div(a, b)}
    if total:
        return out | {"WoW_Pct": out["Revenue_WoW_Pct"], "YoY_Pct": out["Revenue_YoY_Pct"], **{c: F.lit(100.0) for c in ("Share_Pct", "Share_TW_Exact", "Units_Share", "Orders_Share")}}
    t = lambda c: F.col(f"t_{c}")
    share_lw, exact = _div(d("Revenue_LW"), t("Revenue_LW")) * 100, _div(a, t("Revenue_TW")) * 100
    return out | {c: d(c) for c in ("WoW_Pct", "YoY_Pct", "Share_Pct", "Rank")} | {
        "Share_LW": share_lw, "Share_TW_Exact": exact, "Share_WoW_Abs": d("Share_Pct") - share_lw, "Share_WoW_Abs_Exact": exact - share_lw,
        "Units_Share": _div(d("Units_TW"), t("Units_TW")) * 100, "Orders_Share": _div(d("Orders_TW"), t("Orders_TW")) * 100,
    }


def claim_frame(tables: DataFrame) -> DataFrame:
    """``table_id``, ``row`` (an entity, or TOTAL) and ``cells``: a map of the values that a claim can bind to, nulls out."""

    def cells(values: dict[str, Column]) -> Column:
        every = F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)])
        return F.map_filter(every, lambda _, v: v.isNotNull()).alias("cells")

    totals = gate.totals(tables)
    rows = tables.join(totals.select("table_id", *[F.col(c).alias(f"t_{c}") for c in gate.LEVELS]), "table_id")
    return rows.select("table_id", F.col("Entity").alias("row"), cells(_measures(False))).unionByName(totals.select("table_id", F.lit("TOTAL").alias("row"), cells(_measures(True))))


def resolved(metric: Column, period: Column, unit: Column, is_ratio: Column) -> Column:
    """The virtual column that answers a metric and a period for a value of this kind; null if the table has none."""
    measure = F.when(metric.isin("revenue", "sales"), "Revenue").when(metric == "units", "Units").when(metric == "orders", "Orders")
    no_ly = (measure != "Revenue") & period.isin("LY", "YoY")
    level = (
        F.when(is_ratio, F.concat(measure, F.when(period == "LY", "_YoY_Ratio").otherwise("_WoW_Ratio")))
        .when((unit == "percent") & (measure == "Revenue") & (period == "TW"), "Share_Pct").when((unit == "percent") & (measure == "Revenue") & (period == "LW"), "Share_LW")
        .when((unit == "percent") & (measure != "Revenue") & (period == "TW"), F.concat(measure, F.lit("_Share"))).when(unit != "percent", F.concat(measure, F.lit("_"), period))
    )
    change = F.concat(measure, F.lit("_"), period, F.when(is_ratio, "_Ratio").when(unit == "percent", "_Pct").otherwise("_Abs"))
    share = F.when(period == "TW", "Share_Pct").when(period == "LW", "Share_LW").when(period == "WoW", "Share_WoW_Abs")
    return F.when(metric == "rank", "Rank").when(metric == "share", share).when(no_ly, None).when(period.isin("TW", "LW", "LY"), level).when(period.isin("WoW", "YoY"), change)


def kind(col: Column) -> Column:
    """Unit of a virtual column."""
    return F.when(col == "Rank", "rank").when(col.endswith("_Ratio"), "ratio").when(col.rlike("(_Pct|_Share|_Exact)$") | col.startswith("Share"), "percent").when(col.startswith("Revenue"), "currency").otherwise("count")


def _clean(name: Column) -> Column:
    for pattern, by in lx.NAME_CLEANING:
        name = F.regexp_replace(name, pattern, by)
    return F.lower(F.trim(name))


def _words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)))


def rows_of(claims: DataFrame, tables: DataFrame) -> DataFrame:
    """The claim's key, ``row``, ``n_rows`` and ``fuzzy``: the rows of the first stage that finds any (whole table, exact,
    alias, words with the bracketed ones, words, likeness). More than five rows of a words stage are none."""
    low = F.lower(F.trim("entity"))
    total = claims.where(low.isin(TOTAL_WORDS) | low.startswith("total") | low.rlike(lx.WHOLE_TABLE)).select(*KEY, F.lit("TOTAL").alias("row"), F.lit(0).alias("stage"))
    alias = F.create_map(*[F.lit(x) for pair in lx.ALIASES.items() for x in pair])
    names = F.concat(F.array(low, _clean(F.col("entity"))), F.transform(F.regexp_extract_all("entity", F.lit(r"\((.*?)\)"), F.lit(1)), lambda x: F.lower(F.trim(x))))
    asked = claims.select(*KEY, "table_id", names.alias("names"), F.when(F.contains("entity", F.lit("(")), _words(_clean(F.regexp_replace("entity", "[()]", " ")))).alias("bracketed"), _words(_clean(F.col("entity"))).alias("plain"))
    own = tables.select("table_id", F.col("Entity").alias("row"))
    both = asked.join(own, "table_id").withColumn("own", _words(F.col("row")))
    within = lambda c: (F.size(c) > 0) & (F.size(F.array_except(c, "own")) == 0)
    stage = F.when(F.array_contains("names", F.lower("row")), 1).when(F.exists("names", lambda x: alias[x] == F.col("row")), 2).when(within("bracketed"), 3).when(within("plain"), 4)
    every = total.unionByName(both.select(*KEY, "row", stage.alias("stage")).where("stage is not null"))
    # Names that none of these knows are compared by likeness.
    lost = asked.join(every.select(*KEY).distinct(), KEY, "left_anti").join(claims.select(*KEY, _clean(F.col("entity")).alias("base")), KEY).where("base <> ''")
    every = every.unionByName(fuzzy_rows(lost.select(*KEY, "table_id", "base"), tables, KEY, "base").select(*KEY, "row", F.lit(5).alias("stage")))
    claim = Window.partitionBy(*KEY)
    first = every.withColumn("best", F.min("stage").over(claim)).where("stage = best").withColumn("n_rows", F.count(F.lit(1)).over(claim))
    return first.where("stage < 3 or n_rows <= 5").select(*KEY, "row", "n_rows", (F.col("stage") == 5).alias("fuzzy"))


def verify(claims: DataFrame, lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Claims (``note_id``, ``table_id``, ``line_idx``, ``claim_idx``, ``entity``, ``metric``, ``period``, ``value_text``,
    ``direction``, ``qualifier``) with ``label``: Correct, Wrong_entity, Wrong_metric, Wrong_value or Unverifiable."""
    key = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in KEY])
    said = claims.select(key.alias("note_id"), "table_id", F.lit(0).alias("line_idx"), F.col("value_text").alias("line"))
    read = mentions(said).where("skip_reason <> 'date_or_week'").groupBy("note_id").agg(F.min_by(F.struct("cited", "decimals", "scale", "unit", "signed", "is_rank", "is_ratio", "qualifier"), "mention_idx").alias("v")).withColumnRenamed("note_id", "key")
    period = F.upper(F.regexp_replace(F.coalesce(F.nullif(F.trim("period"), F.lit("")), F.lit("TW")), "[- ]", ""))
    period = F.when(period.isin("WOW", "WEEKONWEEK"), "WoW").when(period.isin("YOY", "YEARONYEAR"), "YoY").otherwise(period)
    c = claims.drop("period", "metric").join(claims.select(*KEY, period.alias("period"), F.coalesce(F.nullif(F.lower("metric"), F.lit("")), F.lit("revenue")).alias("metric")), KEY)
    c = c.withColumn("key", key).join(read, "key", "left")
    rank = F.col("metric") == "rank"
    turned = F.col("direction").isin("up", "down") & ~F.col("v.signed") & F.col("period").isin("WoW", "YoY") & ~rank
    level = F.col("period").isin("TW", "LW", "LY") | rank
    cited = F.when(level, F.abs("v.cited")).when(turned, F.abs("v.cited") * F.when(F.col("direction") == "up", 1).otherwise(-1)).otherwise(F.col("v.cited"))
    bare = rank & F.col("v.unit").isin("plain", "count") & ~F.col("v.is_ratio")
    c = c.select(
        *KEY, "table_id", "entity", "metric", "period", "value_text", cited.alias("cited"), F.col("v.decimals").alias("decimals"), F.col("v.scale").alias("scale"), F.when(bare, "count").otherwise(F.col("v.unit")).alias("unit"),
        (~level & (turned | F.col("v.signed"))).alias("signed"), (bare | F.col("v.is_rank")).alias("is_rank"), F.col("v.is_ratio").alias("is_ratio"),
        F.when(F.col("qualifier").isin("approx", "over", "under"), F.col("qualifier")).otherwise(F.col("v.qualifier")).alias("q"),
    ).withColumn("col", resolved(F.col("metric"), F.col("period"), F.col("unit"), F.col("is_ratio")))
    c = stored(c, "values")

    frame = claim_frame(tables)
    entities = stored(gate.named_entities(lines, tables), "named")
    named = entities.groupBy("note_id", "line_idx").agg(F.collect_set("entity").alias("named"))
    r = c.join(stored(rows_of(claims, tables), "rows"), KEY).join(frame, ["table_id", "row"]).join(named, ["note_id", "line_idx"], "left")
    rec = [F.col(x) for x in ("cited", "decimals", "scale", "q")]
    near = lambda value, bounds=False, signed=None: matches(value, *rec, F.col("signed") if signed is None else F.lit(signed), F.lit(bounds))
    fits_unit = lambda col: unit_ok(kind(col), F.col("unit"), F.col("is_rank"), F.col("is_ratio"))
    fits = lambda col: fits_unit(col) & ~col.rlike("(_Share|_Exact)$")
    also = F.create_map(*[F.lit(x) for pair in ALSO.items() for x in pair])
    either = F.when((F.col("unit") == "plain") & F.col("col").endswith("_Abs") & ~F.col("is_ratio"), F.regexp_replace("col", "_Abs", "_Pct"))
    live = F.filter(F.array(F.col("col"), also[F.col("col")], either), lambda x: x.isNotNull() & F.map_contains_key("cells", x))
    r = r.withColumn("live", F.when(F.col("col").isNotNull(), live).otherwise(F.array().cast("array<string>")))
    hit = lambda cells, bounds=False, signed=None: F.exists("live", lambda x: near(F.try_element_at(cells, x), bounds, signed))
    other_column = F.exists(F.map_entries("cells"), lambda e: ~F.array_contains("live", e["key"]) & fits(e["key"]) & near(e["value"]) & ~F.coalesce(e["key"] == also[F.col("col")], F.lit(False)))
    base = F.when(F.col("col").rlike("_(WoW|YoY)_"), F.concat(F.regexp_extract("col", "^([A-Za-z]+)_", 1), F.when(F.contains("col", F.lit("_WoW_")), "_LW").otherwise("_LY")))
    # Of a claim's table only the other rows that hold its value are joined.
    rest = frame.select("table_id", F.col("row").alias("other"), F.col("cells").alias("o_cells"))
    found = r.select(*KEY, "table_id", "row", "live", "cited", "decimals", "scale", "q", "signed").join(rest, "table_id").where((F.col("other") != F.col("row")) & hit(F.col("o_cells")))
    others = found.groupBy(*KEY, "row").agg(F.collect_set("other").alias("others"))
    r = r.join(others, [*KEY, "row"], "left").withColumn("others", F.coalesce("others", F.array().cast("array<string>"))).withColumn("base", base)
    belongs = (F.arrays_overlap("others", F.coalesce("named", F.array().cast("array<string>")))) | ((F.size("others") == 1) & (F.get("live", F.lit(0)) != "Rank"))
    label = (
        F.when(F.col("cited").isNull(), "Unverifiable").when(F.col("col").isNotNull() & (F.col("row") != "TOTAL") & ~fits_unit(F.col("col")), "Derived")
        .when((F.size("live") == 0) & other_column, "Wrong_metric").when((F.size("live") == 0) & (F.try_element_at("cells", F.col("base")) == 0), "Wrong_value").when(F.size("live") == 0, "Unverifiable")
        .when(hit(F.col("cells"), True), "Correct").when(F.col("signed") & hit(F.col("cells"), True, False), "Wrong_value").when(other_column, "Wrong_metric").when(F.coalesce(belongs, F.lit(False)), "Wrong_entity").otherwise("Wrong_value")
    )
    by_row = stored(r.select(*KEY, "row", "n_rows", "fuzzy", label.alias("label")), "by_row")

    # Group figures, and values of another kind than the column's: any value that level 1 would accept for the line.
    line = lines.select("note_id", "line_idx", "table_id", "line")
    in_line = gate.group_values(gate.line_groups(lines, entities, tables), tables).select("note_id", "line_idx", "value", F.col("unit").alias("c_unit"))
    on_entity = entities.select("note_id", "line_idx", "table_id", "entity").distinct().join(gate.entity_values(tables), ["table_id", "entity"]).select("note_id", "line_idx", "value", F.col("unit").alias("c_unit"))
    on_table = line.select("note_id", "line_idx", "table_id").join(gate.table_values(tables), "table_id").select("note_id", "line_idx", "value", F.col("unit").alias("c_unit"))
    pool = in_line.unionByName(on_entity).unionByName(on_table)
    ok = unit_ok(F.col("c_unit"), F.col("unit"), F.col("is_rank"), F.col("is_ratio"))
    group_hit = c.join(pool, ["note_id", "line_idx"]).where(ok & near(F.col("value"))).select(*KEY).distinct().withColumn("group_hit", F.lit(True))
    derived = by_row.where("label = 'Derived'").join(c, KEY).join(gate.entity_values(tables).select("table_id", F.col("entity").alias("row"), "value", F.col("unit").alias("c_unit")), ["table_id", "row"])
    derived_hit = derived.where(ok & near(F.col("value"))).select(*KEY, "row").distinct().withColumn("derived_hit", F.lit(True))
    settled = by_row.join(derived_hit, [*KEY, "row"], "left").withColumn("label", F.when(F.col("label") == "Derived", F.when(F.col("derived_hit"), "Correct").otherwise("Unverifiable")).otherwise(F.col("label")))
    best = settled.groupBy(*KEY).agg(F.max("n_rows").alias("n_rows"), F.bool_or(F.col("label") == "Correct").alias("correct"), F.max("label").alias("only"), F.bool_or(F.col("row") == "TOTAL").alias("total"), F.bool_or("fuzzy").alias("fuzzy"))

    low = F.lower(F.trim("entity"))
    exact = tables.select("table_id", F.lower("Entity").alias("low")).distinct().withColumn("exact", F.lit(True))
    parts = c.select(*KEY, "table_id", F.explode(F.split("entity", r"\s+(?:and|&|\+)\s+|,\s*")).alias("part")).withColumn("low", F.lower(F.trim("part"))).join(exact, ["table_id", "low"]).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_parts"))
    subset = F.lower("line").rlike(r"\b(top|combined|together|lines|colourways|these|both|between them|family)\b")
    out = c.withColumn("low", low).join(exact, ["table_id", "low"], "left").join(parts, KEY, "left").join(best, KEY, "left").join(group_hit, KEY, "left").join(line.drop("table_id"), ["note_id", "line_idx"], "left")
    group = F.col("exact").isNull() & (F.col("low").startswith("group") | F.col("low").isin(GROUP_WORDS) | (F.coalesce("n_parts", F.lit(0)) >= 2))
    found = F.coalesce("group_hit", F.lit(False))
    final = (
        F.when(F.col("cited").isNull(), "Unverifiable").when(group & F.col("line").isNull(), "Unverifiable").when(group & found, "Correct").when(group, "Wrong_value").when(F.col("n_rows").isNull(), "Unverifiable")
        .when(F.col("correct"), "Correct").when(F.col("total") & subset & found, "Correct").when(F.col("n_rows") > 1, "Unverifiable")
        .when(F.col("fuzzy") & F.col("only").startswith("Wrong"), "Unverifiable").otherwise(F.col("only"))
    )
    return out.select(*KEY, "table_id", "entity", "metric", "period", "value_text", final.alias("label"))


def values_of(claims: DataFrame) -> DataFrame:
    """The claim's key and what its value text says: the first number that is no date."""
    key = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in KEY])
    said = claims.select(key.alias("note_id"), "table_id", F.lit(0).alias("line_idx"), F.col("value_text").alias("line"))
    read = mentions(said).where("skip_reason <> 'date_or_week'").groupBy("note_id").agg(F.min_by(F.struct("unit", "is_ratio"), "mention_idx").alias("v"))
    parts = F.split("note_id", "\x1f")
    return read.select(parts[0].alias("note_id"), parts[1].cast("int").alias("line_idx"), parts[2].cast("int").alias("claim_idx"), "v.unit", "v.is_ratio")


def note_claims(notes: DataFrame, tables: DataFrame) -> DataFrame:
    """The claims that rules read from notes; see ``extraction.regex_claims``."""
    lines = note_lines(notes)
    spans = stored(entity_spans(lines, tables), "spans")
    return regex_claims(gate.figures(mentions(lines), spans, tables), lines, spans)


def level2(notes: DataFrame, tables: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Labelled claims of notes: given ones, or those that rules read, after the words beside the values have corrected
    them."""
    lines = note_lines(notes)
    said = stored(note_claims(notes, tables), "claims") if claims is None else claims
    return verify(stored(hinted(said, lines, values_of(said)), "hinted"), lines, tables)


def claim_rates(labelled: DataFrame) -> DataFrame:
    """Claim error rate and binding error rate (wrong entity or metric) of each note; null where none can be verified."""
    count = lambda *x: F.count_if(F.col("label").isin(*x))
    c = labelled.groupBy("note_id", "table_id").agg(count("Correct").alias("n_correct"), count("Wrong_entity", "Wrong_metric").alias("n_binding"), count("Wrong_value").alias("n_wrong_value"))
    n = F.col("n_correct") + F.col("n_binding") + F.col("n_wrong_value")
    return c.select("*", F.when(n > 0, (F.col("n_binding") + F.col("n_wrong_value")) / n).alias("claim_error_rate"), F.when(n > 0, F.col("n_binding") / n).alias("binding_error_rate"))


REPLY_DDL = "claims array<struct<line:int,entity:string,metric:string,period:string,value_text:string,direction:string,qualifier:string>>"


def claims_of_replies(replies: DataFrame) -> DataFrame:
    """Claims in an extractor's replies (``note_id``, ``table_id``, ``reply``): the JSON object from the first brace to the
    last. A reply that is no such object has no claim; see ``unread_replies``."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    rows = replies.select("note_id", "table_id", F.posexplode(F.from_json(body, REPLY_DDL)["claims"]).alias("claim_idx", "c"))
    text = lambda name, default: F.coalesce(F.col(f"c.{name}"), F.lit(default)).alias(name)
    return rows.where("c is not null").select("note_id", "table_id", F.coalesce("c.line", F.lit(-1)).alias("line_idx"), "claim_idx", text("entity", ""), text("metric", ""), text("period", ""), text("value_text", ""), text("direction", "none"), text("qualifier", "none"))


def unread_replies(replies: DataFrame) -> DataFrame:
    """The notes whose reply holds no list of claims."""
    return replies.where(F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), REPLY_DDL)["claims"].isNull()).select("note_id")


def extraction_status(notes: DataFrame, replies: DataFrame) -> DataFrame:
    """``note_id`` and how its claims come about: ``regex`` where rules read them (``model`` is mock), ``model`` where the reply
    holds a list of claims, ``extract_failed`` where it does not, ``budget_stop`` where no reply was paid for."""
    good = F.from_json(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), REPLY_DDL)["claims"].isNotNull()
    said = replies.groupBy("note_id").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("good"))
    status = F.when(F.col("model") == "mock", "regex").when(F.col("good"), "model").when(F.col("good").isNotNull(), "extract_failed").otherwise("budget_stop")
    return notes.join(said, "note_id", "left").select("note_id", status.alias("status"))
