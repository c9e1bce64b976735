"""Level 1 of the number gate: is each cited number a cell of its table, or a derived value?

Candidates are rows and the comparison is a join on the table with the rounding rule as its residual condition; the first
hit by (step, place) is the evidence. All tables here are long tables keyed by ``table_id``."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import lexicons as lx
from factledger.functions.matching import cell, matches, places
from factledger.operators.names import LINE, entity_spans
from factledger.sources.scratch import stored

# Numeric columns in the order in which cells are tried, and their units.
COLUMNS = {
    "Revenue_TW": "currency", "Revenue_LW": "currency", "Revenue_LY": "currency", "Units_TW": "count", "Units_LW": "count", "Orders_TW": "count", "Orders_LW": "count",
    "WoW_Pct": "percent", "YoY_Pct": "percent", "Share_Pct": "percent", "Rank": "rank",
}
MEASURES = {"Revenue": "currency", "Units": "count", "Orders": "count"}
PAIRS = [("Revenue", "LW"), ("Revenue", "LY"), ("Units", "LW"), ("Orders", "LW")]
LEVELS = [c for c, u in COLUMNS.items() if u in ("currency", "count")]
SHARED = ["Revenue_TW", "Revenue_LW", "Units_TW", "Units_LW", "Orders_TW", "Orders_LW"]


def _nobody() -> Column:
    return F.array().cast("array<string>")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _change(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b * 100)


def _rows(values: list[tuple[str, str, Column, list[str]]]) -> Column:
    """One row a value: its form, unit and value, and the columns that it is made of (``reads``)."""
    one = lambda i, form, unit, value, reads: F.struct(F.lit(i).alias("ord"), F.lit(form).alias("form"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.array(*map(F.lit, reads)).alias("reads"))
    return F.explode(F.array(*[one(i, *x) for i, x in enumerate(values)]))


def made_of(form: str, period: str) -> list[str]:
    """The columns of a figure per order or per unit."""
    return {"per_order": [f"Revenue_{period}", f"Orders_{period}"], "per_unit": [f"Revenue_{period}", f"Units_{period}"], "units_per_order": [f"Units_{period}", f"Orders_{period}"]}[form]


def cells(tables: DataFrame) -> DataFrame:
    """table_id, entity, ord, form, value, unit, reads of each cell."""
    return tables.select("table_id", F.col("Entity").alias("entity"), _rows([(c, u, F.col(c), [c]) for c, u in COLUMNS.items()]).alias("x")).select("table_id", "entity", "x.*").where("value is not null")


def totals(tables: DataFrame) -> DataFrame:
    """Exact sums by table. Sums of a group are sums of these columns over its members too."""
    return tables.groupBy("table_id").agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in LEVELS], F.count(F.lit(1)).alias("n"))


def table_values(tables: DataFrame) -> DataFrame:
    """table_id, ord, form, value, unit, reads, members of the values that hang on no entity; the members of sums over the
    first rows, and of what comes after them, are those first rows."""
    stats = []
    aggs = []
    for c, u in COLUMNS.items():
        if u == "rank":
            continue
        for op, f in [("sum", F.sum(F.col(c).cast("decimal(18,4)")).cast("double")), ("mean", F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count(c)), ("median", F.median(c)), ("max", F.max(c).cast("double")), ("min", F.min(c).cast("double"))]:
            if u == "percent" and op in ("sum", "median"):
                continue
            aggs.append(f.alias(f"{op}_{c}"))
            stats.append((f"{op}({c})", u, F.col(f"{op}_{c}"), [c]))
    t = tables.groupBy("table_id").agg(*aggs, F.count(F.lit(1)).alias("n"))
    values = [*stats, ("count(rows)", "count", F.col("n"), [])]
    s = lambda m, p: F.col(f"sum_{m}_{p}")
    for m, p in PAIRS:
        a, b = s(m, "TW"), s(m, p)
        names = f"sum({m}_TW), sum({m}_{p})"
        two = [f"{m}_TW", f"{m}_{p}"]
        values += [(f"diff({names})", MEASURES[m], a - b, two), (f"pct_change({names})", "percent", _change(a, b), two), (f"pct_of({names})", "percent", _ratio(a, b) * 100, two), (f"ratio({names})", "ratio", _ratio(a, b), two)]
    each = {}
    for p in ("TW", "LW"):
        each[p] = {"per_order": _ratio(s("Revenue", p), s("Orders", p)), "per_unit": _ratio(s("Revenue", p), s("Units", p)), "units_per_order": _ratio(s("Units", p), s("Orders", p))}
        values += [
            (f"per_order(sum(Revenue_{p}))", "currency", each[p]["per_order"], made_of("per_order", p)), (f"per_unit(sum(Revenue_{p}))", "currency", each[p]["per_unit"], made_of("per_unit", p)),
            (f"units_per_order(sum(Units_{p}))", "count", each[p]["units_per_order"], made_of("units_per_order", p)),
        ]
    values += [(f"pct_change({n}(TW), {n}(LW))", "percent", _change(each["TW"][n], each["LW"][n]), made_of(n, "TW") + made_of(n, "LW")) for n in each["TW"]]
    plain = t.select("table_id", _rows(values).alias("x")).select("table_id", "x.*")
    order = Window.partitionBy("table_id").orderBy(F.desc("Revenue_TW"), "Entity")
    money = F.col("Revenue_TW").cast("decimal(18,2)")
    run = tables.select("table_id", F.row_number().over(order).alias("k"), F.collect_list("Entity").over(order.rowsBetween(-9, 0)).alias("members"), F.sum(money).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("top"), F.sum(money).over(Window.partitionBy("table_id")).cast("double").alias("all")).where("k <= 10")
    forms = F.array(*[F.struct(F.format_string(f"{n}%d(Revenue_TW)", "k").alias("form"), v.alias("value"), F.lit(u).alias("unit"), least.alias("ok")) for n, v, u, least in [
        ("sum_top", F.col("top"), "currency", F.col("k") > 1), ("share_top", F.col("top") / F.col("all") * 100, "percent", F.col("k") > 1),
        ("sum_after_top", F.col("all") - F.col("top"), "currency", F.lit(True)), ("share_after_top", (F.col("all") - F.col("top")) / F.col("all") * 100, "percent", F.lit(True)),
    ]])
    topk = run.select("table_id", "k", "members", F.posexplode(forms).alias("i", "x")).where("x.ok").select("table_id", (200 + F.col("k") * 4 + F.col("i")).alias("ord"), "x.form", "x.value", "x.unit", F.array(F.lit("Revenue_TW")).alias("reads"), "members")
    return plain.withColumn("members", _nobody()).unionByName(topk).where("value is not null")


def entity_values(tables: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """table_id, entity, ord, form, value, unit, reads of the values that hang on one entity; made once a table, not once a
    note. ``only``: the entities (table_id, entity) that are asked for."""
    t = totals(tables).select("table_id", F.col("n").alias("t_n"), *[F.col(c).alias(f"t_{c}") for c in LEVELS])
    d = lambda c: F.col(c).cast("double")
    values = []
    for m, p in PAIRS:
        a, b, names = d(f"{m}_TW"), d(f"{m}_{p}"), f"{m}_TW, {m}_{p}"
        two = [f"{m}_TW", f"{m}_{p}"]
        values += [(f"diff({names})", MEASURES[m], a - b, two), (f"pct_change({names})", "percent", _change(a, b), two), (f"pct_of({names})", "percent", _ratio(a, b) * 100, two), (f"ratio({names})", "ratio", _ratio(a, b), two)]
    for c in SHARED:
        mean = F.col(f"t_{c}") / F.col("t_n")
        values += [(f"share({c})", "percent", _ratio(d(c), F.col(f"t_{c}")) * 100, [c]), (f"diff({c}, mean)", COLUMNS[c], d(c) - mean, [c]), (f"pct_change({c}, mean)", "percent", _change(d(c), mean), [c]), (f"ratio({c}, mean)", "ratio", _ratio(d(c), mean), [c])]
    values.append(("share_change_pp", "percent", _ratio(d("Revenue_TW"), F.col("t_Revenue_TW")) * 100 - _ratio(d("Revenue_LW"), F.col("t_Revenue_LW")) * 100, ["Revenue_TW", "Revenue_LW"]))
    for m, u in MEASURES.items():
        tw, lw = F.col(f"t_{m}_TW") - d(f"{m}_TW"), F.col(f"t_{m}_LW") - d(f"{m}_LW")
        values += [(f"sum_excluding({m}_TW)", u, tw, [f"{m}_TW"]), (f"sum_excluding({m}_LW)", u, lw, [f"{m}_LW"]), (f"pct_change(sum_excluding {m})", "percent", _change(tw, lw), [f"{m}_TW", f"{m}_LW"])]
    for p in ("TW", "LW"):
        values += [(f"{n}({p})", u, _ratio(*map(d, made_of(n, p))), made_of(n, p)) for n, u in (("units_per_order", "count"), ("per_order", "currency"), ("per_unit", "currency"))]
    rows = tables if only is None else tables.join(only.select("table_id", F.col("entity").alias("Entity")).distinct(), ["table_id", "Entity"], "left_semi")
    return rows.join(t, "table_id").select("table_id", F.col("Entity").alias("entity"), _rows(values).alias("x")).select("table_id", "entity", "x.*").where("value is not null")


def named_entities(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """note_id, line_idx, table_id, entity of the entities that a line names."""
    return entity_spans(lines, tables).select(*LINE, "table_id", "entity").distinct()


def numbered_names(tables: DataFrame) -> DataFrame:
    """table_id and ``numbered``: the runs of two words in its names of which one is a number."""
    words = F.regexp_extract_all(F.replace(F.lower("Entity"), F.lit("'s"), F.lit("")), F.lit("([a-z0-9]+)"), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    runs = tables.select("table_id", words.alias("w")).where("size(w) >= 2").select("table_id", F.explode(pairs).alias("run"))
    return runs.where(F.col("run").rlike(r"(^| )[0-9]+( |$)")).groupBy("table_id").agg(F.collect_set("run").alias("numbered"))


def _in_short_name() -> Column:
    """Whether a bare integer and the word beside it stand in a name, as in "the 50'S CHRISTMAS kit"."""
    bare = F.col("unit").isin("plain", "count") & (F.col("decimals") == 0) & (F.col("scale") == 1) & ~F.col("is_rank")
    before = F.regexp_extract_all(F.lower(F.expr("substring(line, 1, position)")), F.lit("([a-z]+)"), F.lit(1))
    after = F.regexp_extract(F.regexp_replace(F.lower(F.expr("substring(line, end + 1)")), "^['\u2019]s", ""), "^[^a-z]*([a-z]+)", 1)
    dull = [*lx.FAMILY_STOP, *lx.UP_WORDS, *lx.DOWN_WORDS]
    prev = F.coalesce(F.get(before, F.size(before) - 1), F.lit(""))
    runs = F.array(F.when((prev != "") & ~prev.isin(dull), F.concat(prev, F.lit(" "), "raw_text")), F.when((after != "") & ~after.isin(dull), F.concat("raw_text", F.lit(" "), after)))
    return bare & F.coalesce(F.arrays_overlap(F.filter(runs, lambda x: x.isNotNull()), F.col("numbered")), F.lit(False))


def figures(mentions: DataFrame, spans: DataFrame, tables: DataFrame) -> DataFrame:
    """The mentions with ``named`` (entities of the line), and ``skip_reason`` entity_name where a number is part of a name."""
    by_line = spans.groupBy(*LINE).agg(F.collect_set("entity").alias("named"), F.collect_list(F.struct("start", "end")).alias("covered"))
    m = mentions.join(by_line, LINE, "left").join(numbered_names(tables), "table_id", "left")
    inside = F.coalesce(F.exists("covered", lambda x: (F.col("position") < x["end"]) & (F.col("end") > x["start"])), F.lit(False)) | ((F.col("skip_reason") == "") & _in_short_name())
    reason = F.when(F.col("skip_reason").isin("date_or_week"), F.col("skip_reason")).when(inside, "entity_name").otherwise(F.col("skip_reason"))
    return m.select(*[c for c in mentions.columns if c != "skip_reason"], reason.alias("skip_reason"), F.coalesce("named", F.array().cast("array<string>")).alias("named"))


def line_groups(lines: DataFrame, named: DataFrame, tables: DataFrame) -> DataFrame:
    """note_id, line_idx, group, entity: all named together, each family of the line, and the families' union.

    A family is a run of one to three words of the line that two to twenty names hold; the run meets the names in an
    equi-join on word runs."""

    def grams(words: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    def runs(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))
        return F.array_distinct(F.concat(*[grams(words, n) for n in (3, 2, 1)]))

    stop = "^(?:(?:" + "|".join(lx.FAMILY_STOP) + ")(?: |$))+$"
    asked = lines.select("note_id", "line_idx", "table_id", F.explode(runs(F.col("line"))).alias("run")).where(~F.col("run").rlike(stop) & (F.contains("run", F.lit(" ")) | (F.char_length("run") >= 6)))
    held = tables.select("table_id", "Entity", F.explode(runs(F.col("Entity"))).alias("run")).withColumnRenamed("Entity", "entity")
    members = asked.join(held, ["table_id", "run"]).groupBy("note_id", "line_idx", "table_id", "run").agg(F.sort_array(F.collect_set("entity")).alias("members")).where("size(members) between 2 and 20")
    # The longest run of each set of members, then the six longest.
    words = F.size(F.split("run", " "))
    first = members.groupBy("note_id", "line_idx", "table_id", "members").agg(F.max_by("run", F.struct(words, F.char_length("run"), "run")).alias("run"))
    six = first.withColumn("rank", F.row_number().over(Window.partitionBy("note_id", "line_idx").orderBy(F.desc(F.char_length("run")), "run"))).where("rank <= 6")
    union = six.groupBy("note_id", "line_idx", "table_id").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("members")).where("n >= 2 and size(members) <= 24")
    together = named.groupBy("note_id", "line_idx", "table_id").agg(F.collect_set("entity").alias("members")).where("size(members) >= 2")
    out = together.select("note_id", "line_idx", "table_id", F.lit("group").alias("label"), "members")
    out = out.unionByName(six.select("note_id", "line_idx", "table_id", F.concat(F.lit("family "), "run").alias("label"), "members")).unionByName(union.select("note_id", "line_idx", "table_id", F.lit("families").alias("label"), "members"))
    return out.select("note_id", "line_idx", "table_id", "label", F.explode("members").alias("entity"))


def group_values(groups: DataFrame, tables: DataFrame) -> DataFrame:
    """note_id, line_idx, table_id, ord, form, value, unit of the values of each group."""
    t = totals(tables).select("table_id", *[F.col(c).alias(f"t_{c}") for c in LEVELS])
    rows = groups.join(tables.withColumnRenamed("Entity", "entity"), ["table_id", "entity"])
    sums = rows.groupBy("note_id", "line_idx", "table_id", "label").agg(
        F.sort_array(F.collect_set("entity")).alias("members"), *[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in LEVELS], (F.sum(F.col("Revenue_TW").cast("decimal(18,2)")).cast("double") / F.count("Revenue_TW")).alias("mean"), F.sum(F.col("Share_Pct").cast("decimal(18,2)")).cast("double").alias("shares")
    ).join(t, "table_id")
    values = [(f"sum({m}_TW)", u, F.col(f"{m}_TW"), [f"{m}_TW"]) for m, u in MEASURES.items()]
    for m, p in PAIRS:
        a, b = F.col(f"{m}_TW"), F.col(f"{m}_{p}")
        two = [f"{m}_TW", f"{m}_{p}"]
        values += [(f"sum({m}_{p})", MEASURES[m], b, two[1:]), (f"diff(sum {m}_TW, {m}_{p})", MEASURES[m], a - b, two), (f"pct_change(sum {m}_TW, {m}_{p})", "percent", _change(a, b), two)]
    for c in ("Revenue_TW", "Revenue_LW", "Units_TW", "Orders_TW"):
        total = F.col(f"t_{c}")
        values += [(f"share({c})", "percent", _ratio(F.col(c), total) * 100, [c]), (f"sum_outside({c})", COLUMNS[c], total - F.col(c), [c]), (f"share_outside({c})", "percent", _ratio(total - F.col(c), total) * 100, [c])]
    values += [("mean(Revenue_TW)", "currency", F.col("mean"), ["Revenue_TW"]), ("sum(Share_Pct)", "percent", F.col("shares"), ["Share_Pct"])]
    out = sums.select("note_id", "line_idx", "table_id", "label", "members", _rows(values).alias("x"))
    return out.select("note_id", "line_idx", "table_id", (1000 + F.col("x.ord")).alias("ord"), F.concat("label", F.lit(": "), "x.form").alias("form"), "x.value", "x.unit", "x.reads", "members").where("value is not null")


def pair_values(named: DataFrame, tables: DataFrame) -> DataFrame:
    """Differences of the cells of each ordered pair that a line names, and changes and ratios of those that aren't
    percentages."""
    cell = cells(tables).where("unit <> 'rank'")
    one = named.select("note_id", "line_idx", "table_id", "entity").distinct()
    a = one.join(cell.select("table_id", "entity", "ord", F.col("form").alias("col"), F.col("value").alias("x"), "unit"), ["table_id", "entity"]).withColumnRenamed("entity", "a")
    b = one.join(cell.select("table_id", "entity", "ord", F.col("value").alias("y")), ["table_id", "entity"]).withColumnRenamed("entity", "b")
    both = a.join(b, ["note_id", "line_idx", "table_id", "ord"]).where("a <> b")
    ok = F.col("unit") != "percent"
    forms = F.array(
        F.struct(F.lit("diff").alias("op"), (F.col("x") - F.col("y")).alias("value"), F.col("unit").alias("unit")),
        F.struct(F.lit("pct_change").alias("op"), F.when(ok, _change(F.col("x"), F.col("y"))).alias("value"), F.lit("percent").alias("unit")),
        F.struct(F.lit("ratio").alias("op"), F.when(ok, _ratio(F.col("x"), F.col("y"))).alias("value"), F.lit("ratio").alias("unit")),
    )
    out = both.select("note_id", "line_idx", "table_id", "ord", "a", "b", "col", F.explode(forms).alias("v")).where("v.value is not null")
    return out.select("note_id", "line_idx", "table_id", (500 + F.col("ord")).alias("ord"), F.concat("v.op", F.lit("("), "a", F.lit("."), "col", F.lit(", "), "b", F.lit("."), "col", F.lit(")")).alias("form"), "v.value", "v.unit", F.array("col").alias("reads"), F.array("a", "b").alias("members"))


@dataclass(frozen=True)
class Rule:
    """A version of the rules of level 1: how far a rounded, a scaled and an "about" number may be off, whether hedges count,
    whether a plain number may be a ratio, and whether families of names are groups."""

    version: str = "current"
    rounding: float = 1.0
    scaled_by: float = 0.005
    about_by: float = 0.05
    hedged: bool = True
    strict_plain: bool = False
    families: bool = True


def level1(mentions: DataFrame, lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Every mention with its label under the current rules; see ``level1_versions``."""
    return level1_versions(mentions, lines, tables, [Rule()]).drop("version")


def level1_versions(mentions: DataFrame, lines: DataFrame, tables: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every mention with ``label`` (Supported_cell, Supported_derived, Unsupported, Skipped), ``evidence``, and the
    evidence as ``op``, ``args`` and ``cells``, under each version of the rules. Rules are rows: names, numbers and values meet
    once, by the loosest tolerances, and each pair that met is judged by every version.

    All candidates of a table are one relation, and all of a line another, so the numbers meet each in one join. Names and
    numbers are stored once read, since every kind of candidate needs them."""
    spans = stored(entity_spans(lines, tables), "spans")
    named = spans.select(*LINE, "table_id", "entity").distinct()
    m = stored(figures(mentions, spans, tables), "figures")
    key = [*LINE, "mention_idx"]
    aggregate = F.lower("line").rlike(r"\b(" + "|".join(lx.AGGREGATE_WORDS) + r")\b")
    asked = m.where("skip_reason = ''").select(
        *key, "table_id", "cited", "decimals", "scale", "qualifier", "signed", "unit", "is_rank", "is_ratio", "period_hint", "named", (F.size("named") == 0).alias("free"), ((F.size("named") == 0) | aggregate).alias("aggregate")
    )
    # 1 a cell of a named entity, 2 a value that hangs on named entities, 3 one of the table, 4 any other cell.
    alone = lambda df, step: df.withColumns({"step": F.lit(step), "members": F.array("entity")})
    of_table = alone(cells(tables), 1).unionByName(alone(entity_values(tables, named), 2))
    of_table = of_table.unionByName(table_values(tables).withColumns({"step": F.lit(3), "entity": F.lit(None).cast("string")}))
    own = F.coalesce(F.array_contains("named", F.col("entity")), F.lit(False))
    sums = F.col("form").rlike(r"^(sum|per_order\(sum|per_unit\(sum|units_per_order\(sum)\(")
    step = F.when((F.col("step") == 1) & ~own, 4).otherwise(F.col("step"))
    able = F.when(F.col("step") == 2, own).when(F.col("step") == 3, F.col("aggregate") | sums).otherwise(True)
    hint = (F.col("step") == 1) & own & (F.col("period_hint") != "") & ~F.lower("form").endswith(F.concat(F.lit("_"), "period_hint"))
    pick = [*key, "version", "step", "ord", "form", "entity", "c_value", "members", "reads"]
    spark = tables.sparkSession
    versions = F.broadcast(spark.createDataFrame([astuple(r) for r in rules], "version string, rounding double, scaled_by double, about_by double, hedged boolean, strict_plain boolean, families boolean"))
    loose = {x: max(getattr(r, x) for r in rules) for x in ("rounding", "scaled_by", "about_by")}
    judged = lambda met, bounds: met.crossJoin(versions).where(near(bounds, **{x: F.col(x) for x in ("rounding", "scaled_by", "about_by", "hedged")}) & ~(F.col("strict_plain") & (F.col("unit") == "plain") & (F.col("c_unit") == "ratio")))
    met = meetings(asked, of_table, ["table_id"], **loose)
    hits = judged(met.where(able), own | F.col("free")).withColumn("ord", F.col("ord") + F.when(hint, 100).otherwise(0)).withColumn("step", step).select(*pick)
    of_line = group_values(line_groups(lines, named, tables), tables).unionByName(pair_values(named, tables)).drop("table_id").withColumns({"step": F.lit(2), "entity": F.lit(None).cast("string")})
    known = F.col("families") | ~F.col("form").rlike("^famil(y |ies: )")
    hits = hits.unionByName(judged(meetings(asked, of_line, LINE, **loose), F.lit(True)).where(known).select(*pick))
    best = hits.groupBy(*key, "version").agg(F.min(F.struct("step", "ord", "form", "entity", "c_value", "members", "reads")).alias("hit"))
    label = F.when(F.col("skip_reason") != "", "Skipped").when(F.col("hit.step").isin(1, 4), "Supported_cell").when(F.col("hit").isNotNull(), "Supported_derived").otherwise("Unsupported")
    evidence = F.when(F.col("hit").isNotNull(), F.concat("hit.form", F.lit(" = "), plain(F.col("hit.c_value")))).otherwise("")
    op, args, made = lineage(F.col("hit"))
    return m.crossJoin(versions.select("version")).join(best, [*key, "version"], "left").select(*m.columns, "version", label.alias("label"), evidence.alias("evidence"), op.alias("op"), args.alias("args"), made.alias("cells"))


def meetings(asked: DataFrame, values: DataFrame, on: list[str], **tolerance: float) -> DataFrame:
    """Numbers with the values that they may mean, and few others: they meet in the cells of a grid of magnitudes."""
    places_of = places(*[F.col(c) for c in ("cited", "decimals", "scale", "qualifier", "unit", "is_rank", "is_ratio")], **tolerance)
    put = asked.select("*", F.explode(places_of).alias("at")).select(*asked.columns, F.col("at.unit").alias("c_unit"), F.col("at.cell").alias("cell"))
    known = values.withColumnsRenamed({"value": "c_value", "unit": "c_unit"}).withColumn("cell", cell(F.abs("c_value")))
    return known.join(put, [*on, "c_unit", "cell"])


def plain(value: Column) -> Column:
    """A number with four decimals at most, and one at least, whatever its size."""
    return F.regexp_replace(F.round(value, 4).cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def near(bounds: Column, **rule: Column) -> Column:
    """Whether a number and a value that have met match."""
    return matches(F.col("c_value"), F.col("cited"), F.col("decimals"), F.col("scale"), F.col("qualifier"), F.col("signed"), bounds, **rule)


def lineage(hit: Column) -> tuple[Column, Column, Column]:
    """The operation of an evidence (``cell`` for a cell itself), its arguments (the entity, if it hangs on one, or those of a
    pair or group, and the columns that it reads), and the cells that it was made of: entity (null: every row of the table)
    and column. What a value was made of goes with it from where it is made. Null without evidence."""
    op = F.when(hit["step"].isin(1, 4), "cell").otherwise(F.regexp_extract(F.regexp_replace(hit["form"], "^(?:group|families|family [a-z ]+): ", ""), "^([a-z_]+)", 1))
    who = F.when(F.size(hit["members"]) > 0, hit["members"]).otherwise(F.array(F.lit(None).cast("string")))
    made = F.flatten(F.transform(who, lambda e: F.transform(hit["reads"], lambda c: F.struct(e.alias("entity"), c.alias("column")))))
    some = lambda x: F.when(hit.isNotNull(), x)
    return some(op), some(F.concat(hit["members"], hit["reads"])), some(made)


def note_rates(level1: DataFrame) -> DataFrame:
    """Label counts of each note and its share of unsupported numbers; null where nothing was checked."""
    count = lambda x: F.count_if(F.col("label") == x)
    c = level1.groupBy("note_id", "table_id").agg(*[count(x).alias(f"n_{x.lower()}") for x in ("Supported_cell", "Supported_derived", "Unsupported", "Skipped")])
    checked = F.col("n_supported_cell") + F.col("n_supported_derived") + F.col("n_unsupported")
    return c.select("*", checked.alias("n_checked"), F.when(checked > 0, F.col("n_unsupported") / checked).alias("unsupported_rate"))
