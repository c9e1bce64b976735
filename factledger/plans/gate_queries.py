"""Queries that show the gate's own parts: candidate values of tables and lines, and claims read from generated notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators import claims, extraction, gate, notes, reports, verify
from factledger.operators.mentions import mentions, note_lines
from factledger.plans.report_sql import LINES, report, weekly, with_
from factledger.sources.scratch import stored

TOP = 10
BASE = with_(LINES, weekly("country"), report(TOP)).rstrip()
NAMES = {c: c.lower() for c in gate.COLUMNS}


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.as_tables(reports.report_tables(reports.weekly_sales(spark, sf_dir, "country"), TOP))


def _compared(tables: DataFrame) -> DataFrame:
    """A line for each table that names its first three rows."""
    first = tables.where("Rank <= 3").groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("Rank", "Entity"))).alias("x"))
    return first.select(F.col("table_id").alias("note_id"), "table_id", F.lit(0).alias("line_idx"), F.concat(F.lit("- "), F.array_join(F.col("x.Entity"), ", ")).alias("line"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    return gate.pair_values(gate.named_entities(_compared(tables), tables), tables).select("table_id", "form", "value", "unit")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    lines = _compared(tables)
    values = gate.group_values(gate.line_groups(lines, gate.named_entities(lines, tables), tables), tables)
    return values.where(F.col("form").startswith("group: ")).select("table_id", "form", "value", "unit")


def read_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    return claims.note_claims(notes.template_notes(tables)[0], tables).select("table_id", "line_idx", "entity", "metric", "period", "value_text", "direction")


def misread(slots: DataFrame) -> DataFrame:
    """Two claims of each generated line, with the wrong period."""
    said = F.array(
        F.struct(F.lit(0).alias("claim_idx"), F.lit("LW").alias("period"), F.regexp_extract("text", r"(£[0-9,.]+\d)", 1).alias("value_text")),
        F.struct(F.lit(1).alias("claim_idx"), F.lit("YoY").alias("period"), F.regexp_extract("text", r"([0-9.]+%)", 1).alias("value_text")),
    )
    each = slots.select("note_id", "table_id", "line_idx", F.col("Entity").alias("entity"), F.explode(said).alias("c"))
    return each.select("note_id", "table_id", "line_idx", (F.col("line_idx") * 2 + F.col("c.claim_idx")).cast("int").alias("claim_idx"), "entity", F.lit("revenue").alias("metric"), "c.period", "c.value_text", F.lit("none").alias("direction"), F.lit("none").alias("qualifier"))


def corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    note, slots = notes.template_notes(_tables(spark, sf_dir))
    said = misread(slots)
    return extraction.hinted(said, note_lines(note), claims.values_of(said)).select("table_id", "line_idx", "claim_idx", "metric", "period", "adjusted")


def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of the generated notes."""
    found = mentions(note_lines(notes.template_notes(_tables(spark, sf_dir))[0]))
    return found.select("table_id", "line_idx", "mention_idx", "raw_text", "value", "unit", "decimals", "direction", "signed", "position", "skip_reason")


# ---------------------------------------------------------------------------------------------------------------- SQL

TOTALS = "totals as (select week, " + ", ".join(f"cast(sum(cast({NAMES[c]} as decimal(18,2))) as double) as {NAMES[c]}" for c in gate.LEVELS) + ", count(*) as n from report group by week)"
SLOTS = """slots as (select week as table_id, entity, revenue_tw, wow_pct, ('0x' || md5('slot|' || week || '|' || entity)[1:8])::bigint % 100 as draw,
  row_number() over (partition by week order by "rank", entity) - 1 as line_idx from report where "rank" <= 3 and wow_pct is not null),
planted as (select *, draw < 9 as drift, draw >= 9 and draw < 18 as flip, '£' || format('{:,.2f}', case when draw < 9 then revenue_tw * 1.06::double else revenue_tw end) as money,
  case when (wow_pct >= 0) <> (draw >= 9 and draw < 18) then 'up' else 'down' end as way, printf('%.1f', abs(wow_pct)) || '%' as pct from slots)"""


def _union(rows: list[tuple[str, str, str]], keys: str, source: str) -> str:
    return " union all ".join(f"select {keys}, '{form}' as form, cast({value} as double) as value, '{unit}' as unit from {source} where {value} is not null" for form, value, unit in rows)


def _ratio(a: str, b: str) -> str:
    return f"({a}) / nullif(cast({b} as double), 0)"


def _change(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / nullif(cast({b} as double), 0) * 100"


def entity_rows() -> list[tuple[str, str, str]]:
    d = lambda c: f"cast(r.{NAMES[c]} as double)"
    t = lambda c: f"t.{NAMES[c]}"
    rows = []
    for m, p in gate.PAIRS:
        a, b, n = d(f"{m}_TW"), d(f"{m}_{p}"), f"{m}_TW, {m}_{p}"
        rows += [(f"diff({n})", f"({a} - {b})", gate.MEASURES[m]), (f"pct_change({n})", _change(a, b), "percent"), (f"pct_of({n})", f"{_ratio(a, b)} * 100", "percent"), (f"ratio({n})", _ratio(a, b), "ratio")]
    for c in gate.SHARED:
        mean = f"{t(c)} / t.n"
        rows += [(f"share({c})", f"{_ratio(d(c), t(c))} * 100", "percent"), (f"diff({c}, mean)", f"({d(c)} - {mean})", gate.COLUMNS[c]), (f"pct_change({c}, mean)", _change(d(c), mean), "percent"), (f"ratio({c}, mean)", _ratio(d(c), mean), "ratio")]
    rows.append(("share_change_pp", f"{_ratio(d('Revenue_TW'), t('Revenue_TW'))} * 100 - {_ratio(d('Revenue_LW'), t('Revenue_LW'))} * 100", "percent"))
    for m, u in gate.MEASURES.items():
        tw, lw = f"({t(m + '_TW')} - {d(m + '_TW')})", f"({t(m + '_LW')} - {d(m + '_LW')})"
        rows += [(f"sum_excluding({m}_TW)", tw, u), (f"sum_excluding({m}_LW)", lw, u), (f"pct_change(sum_excluding {m})", _change(tw, lw), "percent")]
    for p in ("TW", "LW"):
        rows += [(f"units_per_order({p})", _ratio(d(f"Units_{p}"), d(f"Orders_{p}")), "count"), (f"per_order({p})", _ratio(d(f"Revenue_{p}"), d(f"Orders_{p}")), "currency"), (f"per_unit({p})", _ratio(d(f"Revenue_{p}"), d(f"Units_{p}")), "currency")]
    return rows


def entity_sql() -> str:
    return f"{BASE},\n{TOTALS} " + _union(entity_rows(), "r.week as table_id, r.entity", "report r join totals t using (week)")


def table_rows() -> tuple[list[str], list[tuple[str, str, str]]]:
    """The aggregates of each column, and the values made of them."""
    aggs, rows = [], []
    for c, u in gate.COLUMNS.items():
        n = NAMES[c]
        if u == "rank":
            continue
        total = f"cast(sum(cast({n} as decimal(18,4))) as double)"
        aggs += [f"{total} as sum_{n}", f"{total} / count({n}) as mean_{n}", f"median({n}) as median_{n}", f"max({n}) as max_{n}", f"min({n}) as min_{n}"]
        rows += [(f"{op}({c})", f"{op}_{n}", u) for op in ("sum", "mean", "median", "max", "min") if u != "percent" or op not in ("sum", "median")]
    rows.append(("count(rows)", "n", "count"))
    s = lambda m, p: f"sum_{m.lower()}_{p.lower()}"
    for m, p in gate.PAIRS:
        a, b, n = s(m, "TW"), s(m, p), f"sum({m}_TW), sum({m}_{p})"
        rows += [(f"diff({n})", f"({a} - {b})", gate.MEASURES[m]), (f"pct_change({n})", _change(a, b), "percent"), (f"pct_of({n})", f"{_ratio(a, b)} * 100", "percent"), (f"ratio({n})", _ratio(a, b), "ratio")]
    each = {p: {"per_order": _ratio(s("Revenue", p), s("Orders", p)), "per_unit": _ratio(s("Revenue", p), s("Units", p)), "units_per_order": _ratio(s("Units", p), s("Orders", p))} for p in ("TW", "LW")}
    for p, x in each.items():
        rows += [(f"per_order(sum(Revenue_{p}))", x["per_order"], "currency"), (f"per_unit(sum(Revenue_{p}))", x["per_unit"], "currency"), (f"units_per_order(sum(Units_{p}))", x["units_per_order"], "count")]
    rows += [(f"pct_change({n}(TW), {n}(LW))", _change(each["TW"][n], each["LW"][n]), "percent") for n in each["TW"]]
    return aggs, rows


def table_sql() -> str:
    aggs, rows = table_rows()
    top = """k as (select week, row_number() over o as k, cast(sum(cast(revenue_tw as decimal(18,2))) over (o rows unbounded preceding) as double) as top, cast(sum(cast(revenue_tw as decimal(18,2))) over (partition by week) as double) as total
      from report window o as (partition by week order by revenue_tw desc, entity))"""
    tops = " union all ".join(
        f"select week as table_id, '{form}' || k || '(Revenue_TW)' as form, {value} as value, '{unit}' as unit from k where k between {least} and 10"
        for form, value, unit, least in [("sum_top", "top", "currency", 2), ("share_top", "top / total * 100", "percent", 2), ("sum_after_top", "total - top", "currency", 1), ("share_after_top", "(total - top) / total * 100", "percent", 1)]
    )
    return f"{BASE},\ng as (select week, count(*) as n, {', '.join(aggs)} from report group by week),\n{top} " + _union(rows, "week as table_id", "g") + " union all " + tops


def pair_sql() -> str:
    parts = []
    for c, u in gate.COLUMNS.items():
        if u == "rank":
            continue
        x, y = f"cast(a.{NAMES[c]} as double)", f"cast(b.{NAMES[c]} as double)"
        for op, value, unit in [("diff", f"({x} - {y})", u)] + ([("pct_change", _change(x, y), "percent"), ("ratio", _ratio(x, y), "ratio")] if u != "percent" else []):
            parts.append(f"select a.week as table_id, '{op}(' || a.entity || '.{c}, ' || b.entity || '.{c})' as form, {value} as value, '{unit}' as unit from f a join f b on a.week = b.week and a.entity <> b.entity where {value} is not null")
    return f"{BASE},\nf as (select * from report where \"rank\" <= 3) " + " union all ".join(parts)


SUMS = ", ".join(f"cast(sum(cast({NAMES[c]} as decimal(18,2))) as double) as {NAMES[c]}" for c in gate.LEVELS)


def group_rows() -> list[tuple[str, str, str]]:
    """Values of a group ``g`` of a table with the totals ``t``."""
    rows = [(f"group: sum({m}_TW)", f"g.{m.lower()}_tw", u) for m, u in gate.MEASURES.items()]
    for m, p in gate.PAIRS:
        a, b = f"g.{m.lower()}_tw", f"g.{m.lower()}_{p.lower()}"
        rows += [(f"group: sum({m}_{p})", b, gate.MEASURES[m]), (f"group: diff(sum {m}_TW, {m}_{p})", f"({a} - {b})", gate.MEASURES[m]), (f"group: pct_change(sum {m}_TW, {m}_{p})", _change(a, b), "percent")]
    for c in ("Revenue_TW", "Revenue_LW", "Units_TW", "Orders_TW"):
        a, t = f"g.{NAMES[c]}", f"t.{NAMES[c]}"
        rows += [(f"group: share({c})", f"{_ratio(a, t)} * 100", "percent"), (f"group: sum_outside({c})", f"({t} - {a})", gate.COLUMNS[c]), (f"group: share_outside({c})", f"{_ratio(f'{t} - {a}', t)} * 100", "percent")]
    rows += [("group: mean(Revenue_TW)", "g.mean", "currency"), ("group: sum(Share_Pct)", "g.shares", "percent")]
    return rows


def group_sql() -> str:
    rows = group_rows()
    sums = SUMS
    source = "g join totals t using (week)"
    g = f"g as (select week, count(*) as members, {sums}, cast(sum(cast(revenue_tw as decimal(18,2))) as double) / count(*) as mean, cast(sum(cast(share_pct as decimal(18,2))) as double) as shares from report where \"rank\" <= 3 group by week having count(*) >= 2)"
    return f"{BASE},\n{TOTALS},\n{g} " + _union(rows, "g.week as table_id", source)


def _ordered(rows: list[tuple[str, str, str]], first: int, step: int, entity: str, source: str, table: str) -> str:
    return " union all ".join(f"select {table} as table_id, {entity} as entity, {step} as step, {first + i} as ord, '{form}' as form, cast({value} as double) as value, '{unit}' as unit from {source} where {value} is not null" for i, (form, value, unit) in enumerate(rows))


PLAIN = lambda x: f"regexp_replace(cast(cast(round({x}, 4) as decimal(38,4)) as varchar), '(\\.\\d+?)0+$', '\\1')"


def _near(value: str, rounding: float = 1.0) -> str:
    """Whether a value rounds half up to the number ``m``, on magnitudes; its sign too where the number has one."""
    gap, half = f"(abs({value}) - abs(m.cited))", f"(0.5::double * pow(10.0::double, -m.decimals) * {rounding}::double)"
    return f"({gap} >= -{half} - 1e-9::double and {gap} < {half} - 1e-9::double and (not m.signed or sign({value}) = sign(m.cited) or {value} = 0 or m.cited = 0))"


MENTIONS = """m as (select 'note ' || table_id as note_id, table_id, entity, cast(line_idx as integer) as line_idx, 0 as mention_idx, money as raw_text, cast(replace(money[2:], ',', '') as double) as cited, 2 as decimals, 'currency' as unit, 'none' as direction, false as signed from planted
  union all select 'note ' || table_id, table_id, entity, cast(line_idx as integer), 1, pct, cast(pct[:-2] as double) * case way when 'up' then 1 else -1 end, 1, 'percent', way, true from planted)"""


def _values_sql() -> str:
    """Every value that lines about one entity may mean: its cells and values, those of the entities whose names share its
    word (the only kind of family that names of nations have), sums of the table, other cells."""
    cells = _ordered([(c, f'r."{NAMES[c]}"', u) for c, u in gate.COLUMNS.items()], 0, 1, "r.entity", "report r", "r.week")
    own = _ordered(entity_rows(), 0, 2, "r.entity", "report r join totals t using (week)", "r.week")
    aggs, rows = table_rows()
    sums = [(i, x) for i, x in enumerate(rows) if x[0].startswith(("sum(", "per_order(sum(", "per_unit(sum(", "units_per_order(sum("))]
    table = " union all ".join(_ordered([x], i, 3, "cast(null as varchar)", "ag", "ag.week") for i, x in sums)
    family = [(form.replace("group: ", "family ' || g.word || ': "), value, unit) for form, value, unit in group_rows()]
    group = _ordered(family, 1000, 2, "g.word", "g join totals t using (week)", "g.week")
    return f"""{BASE},
{TOTALS},
ag as (select week, count(*) as n, {", ".join(aggs)} from report group by week),
g as (select week, {WORD.format("entity")} as word, {SUMS}, cast(sum(cast(revenue_tw as decimal(18,2))) as double) / count(*) as mean, cast(sum(cast(share_pct as decimal(18,2))) as double) as shares
  from report where length({WORD.format("entity")}) >= 6 group by week, word having count(*) between 2 and 20),
c as materialized ({cells} union all {own} union all {table} union all {group})"""


WORD = "regexp_extract(lower({}), '[a-z]+')"


def _labelled(numbers: str, n: str = "", rounding: float = 1.0, families: bool = True) -> str:
    """``labelled``: the numbers (note_id, table_id, entity, line_idx, mention_idx, raw_text, cited, decimals, unit, direction,
    signed) with label and evidence; money is said to be of this week."""
    return f"""hit{n} as (select m.note_id, m.line_idx, m.mention_idx, case when c.step = 1 and c.entity <> m.entity then 4 else c.step end as step,
    c.ord + case when c.step = 1 and c.entity = m.entity and m.mention_idx = 0 and not suffix(lower(c.form), '_tw') then 100 else 0 end as ord, c.form, c.entity, c.value
  from {numbers} m join c on c.table_id = m.table_id and c.unit = m.unit
  where (c.step in (1, 3) or c.entity = m.entity or {f"c.entity = {WORD.format('m.entity')}" if families else "false"}) and {_near("c.value", rounding)}),
best{n} as (select note_id, line_idx, mention_idx, arg_min(h, {{'step': step, 'ord': ord, 'form': form, 'entity': coalesce(entity, ''), 'value': value}}) as hit from hit{n} h group by all),
labelled{n} as (select m.*, case when hit is null then 'Unsupported' when hit.step in (1, 4) then 'Supported_cell' else 'Supported_derived' end as label,
    coalesce(hit.form || ' = ' || {PLAIN("hit.value")}, '') as evidence from {numbers} m left join best{n} using (note_id, line_idx, mention_idx))"""


def labels_sql() -> str:
    return f"""{_values_sql()},
{SLOTS},
{MENTIONS},
{_labelled("m")}"""


def drafts_sql(strategies: dict[str, int]) -> str:
    """``slots``: the numbers of every draft with their true values, and what was planted."""
    draw = lambda what, more="": f"('0x' || md5('{what}|' || strategy || '|' || week || '|' || entity || '|' || slot{more})[1:8])::bigint"
    kinds = f"case when {draw('wrong')} % 100 >= rate then 'none' when {draw('kind')} % 10 between {verify.DRIFT} and {verify.DRIFT + verify.SWAP - 1} and n > 1 then 'swap' when {draw('kind')} % 10 >= {verify.DRIFT + verify.SWAP} and slot = 1 then 'flip' else 'drift' end"
    return f"""cells2 as (select week, "rank", entity, wow_pct, 0 as slot, cast(revenue_tw as double) as truth from report where revenue_tw is not null union all select week, "rank", entity, wow_pct, 1, cast(wow_pct as double) from report where wow_pct is not null),
every as (select *, row_number() over (partition by week, slot order by "rank", entity) - 1 as k, count(*) over (partition by week, slot) as n from cells2),
first as (select *, row_number() over (partition by week, slot order by "rank", entity) - 1 as line_idx from every where "rank" <= 3 and wow_pct is not null),
drawn as (select *, {kinds} as planted, ([{", ".join(f"{x}::double" for x in verify.FACTORS)}])[{draw('factor')} % {len(verify.FACTORS)} + 1] as factor, {draw('swap')} % greatest(n - 1, 1) as pick
  from first, (values {", ".join(f"('{s}', {rate})" for s, rate in strategies.items())}) s(strategy, rate)),
slots as (select d.strategy || ' ' || d.week as note_id, d.strategy, d.week, d.entity, d.line_idx, d.slot, d.truth, d.planted,
    case d.planted when 'drift' then d.truth * d.factor when 'swap' then o.truth when 'flip' then -d.truth else d.truth end as value
  from drawn d left join every o on o.week = d.week and o.slot = d.slot and o.k = d.pick + cast(d.pick >= d.k as integer))"""


def _read(slots: str, value: str, also: str = "") -> str:
    """The numbers as they are written and read again."""
    money, change = f"round_even({value} * 100, 0) / 100", f"round_even(abs({value}) * 10, 0) / 10"
    return f"""select note_id, week as table_id, entity, line_idx, slot as mention_idx, strategy, truth, planted, {value} as value, case slot when 0 then '£' || format('{{:,.2f}}', {money}) else printf('%.1f', {change}) || '%' end as raw_text,
    case slot when 0 then {money} else {change} * case when {value} >= 0 then 1 else -1 end end as cited, 2 - slot as decimals, case slot when 0 then 'currency' else 'percent' end as unit, slot = 1 as signed{also} from {slots}"""


def rounds_sql() -> str:
    out = f"{_values_sql()},\n{drafts_sql({'S1': verify.WRONG['S1']})},\nm0 as ({_read('slots', 'value')}),\n{_labelled('m0', '0')}"
    for r in range(1, verify.ROUNDS + 1):
        fix = f"label = 'Unsupported' and ('0x' || md5('repair|' || strategy || '|' || table_id || '|' || entity || '|' || mention_idx || '|{r}')[1:8])::bigint % 100 < {verify.REPAIRED}"
        again = f"(select note_id, table_id as week, entity, line_idx, mention_idx as slot, strategy, truth, planted, case when {fix} then truth else value end as value, {fix} as fixed from labelled{r - 1})"
        out += f",\nm{r} as ({_read(again, 'value', ', fixed')}),\n{_labelled(f'm{r}', str(r))}"
    rates = " union all ".join(f"select {r} as round, strategy, count(*) as n_checked, count(*) filter (label = 'Unsupported') as n_unsupported, count(*) filter (label = 'Unsupported') / count(*) as unsupported_rate from labelled{r}" + (f" where exists (select 1 from m{r} where fixed)" if r else "") + " group by strategy" for r in range(verify.ROUNDS + 1))
    return out + " " + rates


def regated_sql() -> str:
    return f"""{_values_sql()},
{drafts_sql(verify.WRONG)},
m0 as ({_read("slots", "value")}),
{_labelled("m0", "0")},
m1 as ({_read("slots", "truth")}),
{_labelled("m1", "1")}
select a.note_id, a.line_idx, a.mention_idx, a.planted, a.raw_text as raw_before, b.raw_text as raw_after, a.label as label_before, b.label as label_after from labelled0 a join labelled1 b using (note_id, line_idx, mention_idx)"""


VERSIONS = [gate.Rule(), gate.Rule("no_families", families=False), gate.Rule("loose", rounding=12.0)]


def versions_sql() -> str:
    parts = ",\n".join(_labelled("m0", f"_{r.version}", r.rounding, r.families) for r in VERSIONS)
    joined = " join ".join(f"labelled_{r.version} {r.version}" + (" using (note_id, line_idx, mention_idx)" if i else "") for i, r in enumerate(VERSIONS))
    return f"""{_values_sql()},
{drafts_sql({"S1": verify.WRONG["S1"]})},
m0 as ({_read("slots", "value")}),
{parts}
select note_id, line_idx, mention_idx, {", ".join(f"{r.version}.label as {r.version}" for r in VERSIONS)} from {joined}"""


COPIES = 6


def injected_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many planted errors of each kind are flagged in six copies of a note about every week, gated as one plan."""
    tables = stored(_tables(spark, sf_dir), "tables")
    slots = stored(verify.injected(tables, COPIES), "slots")
    return verify.detection(slots, verify.gated(slots, tables))


def injection_sql() -> str:
    z = 1.959963984540054
    mid, half = f"(p + {z * z}::double / (2 * n))", f"{z}::double * sqrt(p * (1 - p) / n + {z * z}::double / (4 * n * n))"
    return f"""{_values_sql()},
{drafts_sql({f"M{k}": verify.INJECTED for k in range(COPIES)})},
m0 as ({_read("slots", "value")}),
{_labelled("m0", "0")},
x as (select planted, count(*) as n, count(*) filter (label = 'Unsupported') as flagged, count(*) filter (label = 'Unsupported') / count(*) as p
  from labelled0 group by planted)
select planted, n, flagged, p as rate,
  case when flagged = 0 then 0.0::double else ({mid} - {half}) / (1 + {z * z}::double / n) end as low,
  case when flagged = n then 1.0::double else ({mid} + {half}) / (1 + {z * z}::double / n) end as high from x"""


def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of the first strategy's drafts with its label under three versions of the rules: the current ones, without
    families, and with roundings that may be off by six of the last place. One run of the gate."""
    tables = stored(_tables(spark, sf_dir), "report")
    lines = stored(verify.lines_of(verify.drafts(tables, {"S1": verify.WRONG["S1"]})), "lines")
    labels = gate.level1_versions(mentions(lines), lines, tables, VERSIONS)
    return labels.groupBy("note_id", "line_idx", "mention_idx").agg(*[F.max(F.when(F.col("version") == r.version, F.col("label"))).alias(r.version) for r in VERSIONS])


def verify_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsupported numbers after each round of the write-and-verify strategy, whose drafts are the first strategy's."""
    tables = stored(_tables(spark, sf_dir), "report")
    slots = stored(verify.drafts(tables, {"S1": verify.WRONG["S1"]}), "slots")
    return verify.round_rates(verify.verified(slots, tables))


def regated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every strategy's draft with its label before and after the true values have been written back."""
    tables = stored(_tables(spark, sf_dir), "report")
    slots = stored(verify.drafts(tables), "slots")
    before = verify.gated(slots, tables)
    after = verify.regated(before, stored(verify.substituted(slots)[1], "changed"), tables)
    key = [*verify.LINE, "mention_idx"]
    two = before.select(*key, F.col("raw_text").alias("raw_before"), F.col("label").alias("label_before")).join(after.select(*key, F.col("raw_text").alias("raw_after"), F.col("label").alias("label_after")), key)
    return two.join(slots.select(*verify.LINE, F.col("slot").alias("mention_idx"), "planted"), key)


def claims_sql() -> str:
    """The revenue of each line against its row's own cell, the row's other money, and the other rows' revenue."""
    money = ["r.revenue_lw", "r.revenue_ly", "r.revenue_tw - r.revenue_lw", "r.revenue_tw - r.revenue_ly"]
    other = " or ".join(f"coalesce({_near(f'cast({x} as double)')}, false)" for x in money)
    return f"""{BASE},
{TOTALS},
{SLOTS},
{MENTIONS},
rows as (select week, entity, cast(revenue_tw as double) as value from report union all select week, 'TOTAL', revenue_tw from totals),
others as (select m.table_id, m.line_idx, count(distinct o.entity) as n from m join rows o on o.week = m.table_id and o.entity <> m.entity where m.mention_idx = 0 and {_near("o.value")} group by all)
select 'note ' || m.table_id as note_id, m.line_idx, 0 as claim_idx, m.table_id, m.entity, 'revenue' as metric, 'TW' as period, m.raw_text as value_text,
  case when {_near("cast(r.revenue_tw as double)")} then 'Correct' when {other} then 'Wrong_metric' when coalesce(others.n, 0) = 1 then 'Wrong_entity' else 'Wrong_value' end as label
from m join report r on r.week = m.table_id and r.entity = m.entity left join others on others.table_id = m.table_id and others.line_idx = m.line_idx where m.mention_idx = 0"""


QUERIES = {
    "rule_versions": rule_versions,
    "verify_rounds": verify_rounds,
    "injected_detection": injected_detection,
    "regated_labels": regated_labels,
    "entity_values": lambda s, d: gate.entity_values(_tables(s, d)).select("table_id", "entity", "form", "value", "unit"),
    "table_values": lambda s, d: gate.table_values(_tables(s, d)).select("table_id", "form", "value", "unit"),
    "pair_values": pairs,
    "group_values": groups,
    "note_numbers": cited,
    "error_injection": lambda s, d: notes.template_notes(_tables(s, d))[1].select("table_id", "line_idx", F.col("Entity").alias("entity"), "text", "planted", "true_value"),
    "regex_claims": read_claims,
    "claim_hints": corrected,
}
COUNTS = ", ".join(f"count(*) filter (label = '{x}') as n_{x.lower()}" for x in ("Supported_cell", "Supported_derived", "Unsupported", "Skipped"))
ORACLES = {
    "level1_labels": labels_sql() + " select note_id, line_idx, mention_idx, raw_text, cited as value, unit, direction, label, evidence from labelled",
    "level1_rates": labels_sql() + f" select *, n_supported_cell + n_supported_derived + n_unsupported as n_checked, n_unsupported / (n_supported_cell + n_supported_derived + n_unsupported) as unsupported_rate from (select note_id, table_id, {COUNTS} from labelled group by all)",
    "claim_labels": claims_sql(),
    "rule_versions": versions_sql(),
    "verify_rounds": rounds_sql(),
    "injected_detection": injection_sql(),
    "regated_labels": regated_sql(),
    "entity_values": entity_sql(),
    "table_values": table_sql(),
    "pair_values": pair_sql(),
    "group_values": group_sql(),
    "note_numbers": BASE + ",\n" + SLOTS + """ select table_id, cast(line_idx as integer) as line_idx, 0 as mention_idx, money as raw_text, cast(replace(money[2:], ',', '') as double) as value, 'currency' as unit, 2 as decimals, 'none' as direction, false as signed,
        length('- ' || entity || ' revenue was ') as position, '' as skip_reason from planted union all
        select table_id, line_idx, 1, pct, cast(pct[:-2] as double) * case way when 'up' then 1 else -1 end, 'percent', 1, way, true, length('- ' || entity || ' revenue was ' || money || ' TW, ' || way || ' '), '' from planted""",
    "error_injection": BASE + ",\n" + SLOTS + """ select table_id, cast(line_idx as integer) as line_idx, entity, '- ' || entity || ' revenue was ' || money || ' TW, ' || way || ' ' || pct || ' WoW' as text,
        case when drift then 'drift' when flip then 'flip' else 'none' end as planted, revenue_tw as true_value from planted""",
    "regex_claims": BASE + ",\n" + SLOTS + """ select table_id, cast(line_idx as integer) as line_idx, entity, 'revenue' as metric, 'TW' as period, money as value_text, 'none' as direction from planted
        union all select table_id, line_idx, entity, 'revenue', 'WoW', pct, way from planted""",
    "claim_hints": BASE + ",\n" + SLOTS + """ select table_id, cast(line_idx as integer) as line_idx, cast(line_idx * 2 as integer) as claim_idx, 'revenue' as metric, 'TW' as period, 'period LW->TW from text' as adjusted from planted
        union all select table_id, line_idx, line_idx * 2 + 1, 'revenue', 'WoW', 'period YoY->WoW from text' from planted""",
}
