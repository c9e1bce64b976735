"""Named queries over the star schema and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.functions import matching
from factledger.functions import text as text_functions
from factledger.operators import candidates, claims, evaluation, gate, notes, reports, spans
from factledger.operators.mentions import mentions, note_lines
from factledger.plans import evaluation_queries, gate_queries, sentence_queries
from factledger.plans.report_sql import LINES, report, weekly, weighed, with_
from factledger.sources.scratch import stored
from factledger.sources.tables import table

TOP = 10
BASE = with_(LINES, weekly("country"), report(TOP))


def _report(spark: SparkSession, sf_dir: str, entity: str = "country") -> DataFrame:
    return reports.report_tables(reports.weekly_sales(spark, sf_dir, entity), TOP)


def _on_report(operator):
    return lambda spark, sf_dir: operator(_report(spark, sf_dir))


REPORT_COLUMNS = 'week, entity, pos, revenue_tw, revenue_lw, revenue_ly, units_tw, units_lw, orders_tw, orders_lw, wow_pct, yoy_pct, share_pct, "rank"'
TOTALS = "totals as (select week, " + ", ".join(f"cast(sum(cast({c} as decimal(18,2))) as double) as {c}" for c in candidates.LEVELS) + ", count(*) as n_rows from report group by week)"
CELLS = "cells as (" + " union all ".join(f"select week, entity, '{c}' as col, cast(\"{c}\" as double) as value, '{u}' as unit from report where \"{c}\" is not null" for c, u in candidates.COLUMN_UNIT.items()) + ")"
PERIODS = [("revenue", "lw"), ("units", "lw"), ("orders", "lw"), ("revenue", "ly")]


def _changes_sql(source: str, keys: str, evidence: str, unit: bool) -> str:
    parts = []
    for m, p in PERIODS:
        a, raw = f"cast({m}_tw as double)", f"cast({m}_{p} as double)"
        b = f"nullif({raw}, 0)"
        for op, value, kind in [("diff", f"{a} - {raw}", candidates.MEASURES[m]), ("pct_change", f"({a} - {b}) / {b} * 100", "percent"), ("pct_of", f"{a} / {b} * 100", "percent"), ("ratio", f"{a} / {b}", "ratio")]:
            parts.append(f"select {keys}, '{evidence.format(op=op, m=m, p=p)}' as evidence, {value} as value{f', {chr(39)}{kind}{chr(39)} as unit' if unit else ''} from {source} where {value} is not null")
    return " union all ".join(parts)


def match_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts against themselves as cited in whole thousands, rounded or hedged."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("true"), F.pmod("p_partkey", F.lit(6)).alias("kind"))
    cited = F.when(F.col("kind") == 0, F.rint("true")).when(F.col("kind") == 1, F.rint(F.col("true") / 100) / 10).when(F.col("kind") == 2, F.col("true") * 1.04).when(F.col("kind") == 3, F.col("true") / 1.2).when(F.col("kind") == 5, F.col("true") * F.when(F.col("p_partkey") % 4 < 2, 1.3).otherwise(0.9)).otherwise(-F.col("true"))
    args = p.select(
        "p_partkey", "true", cited.alias("cited"), F.when(F.col("kind") == 1, 1).otherwise(F.when(F.col("kind") == 0, 0).otherwise(2)).alias("decimals"),
        F.when(F.col("kind") == 1, 1000.0).otherwise(1.0).alias("scale"), F.when(F.col("kind") == 2, "approx").when(F.col("kind") == 3, "over").when(F.col("kind") == 5, "under").otherwise("none").alias("qualifier"), (F.col("kind") == 4).alias("signed"),
    )
    return args.select("p_partkey", matching.matches(F.col("true"), F.col("cited"), F.col("decimals"), F.col("scale"), F.col("qualifier"), F.col("signed"), F.lit(True)).alias("ok"))


MATCH_SQL = """with a as (select p_partkey, p_retailprice as t, p_partkey % 6 as kind from part),
c as (select p_partkey, t, case kind when 0 then round_even(t, 0) when 1 then round_even(t / 100, 0) / 10 when 2 then t * 1.04 when 3 then t / 1.2 when 5 then t * case when p_partkey % 4 < 2 then 1.3::double else 0.9::double end else -t end as cited,
  case kind when 1 then 1 when 0 then 0 else 2 end as d, case kind when 1 then 1000.0 else 1.0 end::double as s,
  case kind when 2 then 'approx' when 3 then 'over' when 5 then 'under' else 'none' end as q, kind = 4 as signed from a),
h as (select *, abs(t) as ta, abs(cited) as ca, 0.5::double * pow(10.0::double, -d) as half from c)
select p_partkey, ((ta / s - ca >= -half - 1e-9::double and ta / s - ca < half - 1e-9::double) or (s > 1 and abs(ta - ca * s) <= 0.005::double * ta) or (q = 'approx' and abs(ta - ca * s) <= 0.05::double * ta)
  or (q = 'over' and ta >= ca * s - half * s and ta <= 1.5::double * (ca * s))
  or (q = 'under' and ta <= ca * s + half * s and ta >= (ca * s) / 1.5::double and ta > 0)) and (not signed or sign(t) = sign(cited) or t = 0 or cited = 0) as ok from h"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as verdicts: flagged where returned, checked always; by status and quarter of the year."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_linestatus").alias("strategy"), F.quarter("l_shipdate").cast("string").alias("size"), (F.col("l_returnflag") == "R").cast("long").alias("num"), F.lit(1).cast("long").alias("den"))


SETS = [[], ["strategy"], ["size"], ["strategy", "size"]]


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.sum((F.col("c_acctbal") < 0).cast("long")).alias("num"), F.count(F.lit(1)).alias("den"))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).select(F.col("n_name").alias("name"), (F.col("num") / F.col("den") / 4).alias("p"))


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sides come from lines dealt out by order once: what repeats changes neither the least nor the greatest."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).repartition("l_orderkey")
    left = item.groupBy("l_orderkey", F.col("l_partkey").alias("l_id")).agg(F.min("l_suppkey").alias("l_start"), F.max(F.col("l_suppkey") + F.col("q")).alias("l_end"))
    right = item.groupBy("l_orderkey", F.col("l_suppkey").alias("r_id")).agg(F.min("l_partkey").alias("r_start"), F.max(F.col("l_partkey") + 2 * F.col("q")).alias("r_end"))
    return left, right


def best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return spans.best_overlap(*_spans(spark, sf_dir), ["l_orderkey"], lines)


SPANS_SQL = """with item as (select distinct l_orderkey, l_partkey, l_suppkey, cast(l_quantity as bigint) as q from lineitem),
l as (select l_orderkey, l_partkey as l_id, min(l_suppkey) as l_start, max(l_suppkey + q) as l_end from item group by 1, 2),
r as (select l_orderkey, l_suppkey as r_id, min(l_partkey) as r_start, max(l_partkey + 2 * q) as r_end from item group by 1, 2),
j as (select *, least(l_end, r_end) - greatest(l_start, r_start) as overlap from l join r using (l_orderkey) where least(l_end, r_end) - greatest(l_start, r_start) > 0)
select * exclude (pick) from (select *, row_number() over (partition by l_orderkey, l_id order by overlap desc, r_start, r_id) as pick from j) where pick = 1"""

def _level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a generated note about every week of the report. The report is read by every kind of candidate, so it
    is stored once made, and so are the notes."""
    tables = stored(notes.as_tables(_report(spark, sf_dir)), "report")
    lines = stored(note_lines(notes.template_notes(tables)[0]), "lines")
    return gate.level1(mentions(lines), lines, tables)


def level1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _level1(spark, sf_dir).select("note_id", "line_idx", "mention_idx", "raw_text", "value", "unit", "direction", "label", "evidence")


def claim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revenue claim of each line of the generated notes, bound to its table."""
    tables = stored(notes.as_tables(_report(spark, sf_dir)), "report")
    note, slots = notes.template_notes(tables)
    return claims.verify(stored(notes.template_claims(slots), "claims"), stored(note_lines(note), "lines"), tables)


def claim_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = claims.claim_frame(notes.as_tables(_report(spark, sf_dir)))
    return frame.select(F.col("table_id").alias("week"), F.col("row").alias("entity"), F.explode("cells").alias("col", "value"))


def frame_sql() -> str:
    """Every virtual column of every row and of the total, one after the other."""
    parts = []
    for total in (False, True):
        c = lambda x: f"cast({'t' if total else 'r'}.{x} as double)"  # noqa: B023, E731
        change = lambda a, b: f"({c(a)} - {c(b)})"  # noqa: B023, E731
        over = lambda a, b: f"({a}) / nullif(cast({b} as double), 0)"
        cells = {x: c(x.lower()) for x in gate.LEVELS}
        for m in gate.MEASURES:
            a, b = f"{m.lower()}_tw", f"{m.lower()}_lw"
            cells |= {f"{m}_WoW_Abs": change(a, b), f"{m}_WoW_Pct": over(change(a, b), c(b)) + " * 100", f"{m}_WoW_Ratio": over(c(a), c(b))}
        yoy = f"case when {c('revenue_ly')} > 0 then {change('revenue_tw', 'revenue_ly')} / {c('revenue_ly')} * 100 end"
        cells |= {"Revenue_YoY_Abs": change("revenue_tw", "revenue_ly"), "Revenue_YoY_Pct": yoy, "Revenue_YoY_Ratio": over(c("revenue_tw"), c("revenue_ly"))}
        if total:
            cells |= {"WoW_Pct": cells["Revenue_WoW_Pct"], "YoY_Pct": yoy, **dict.fromkeys(("Share_Pct", "Share_TW_Exact", "Units_Share", "Orders_Share"), "100.0::double")}
        else:
            lw, tw = over(c("revenue_lw"), "t.revenue_lw") + " * 100", over(c("revenue_tw"), "t.revenue_tw") + " * 100"
            cells |= {x: c(x.lower() if x != "Rank" else '"rank"') for x in ("WoW_Pct", "YoY_Pct", "Share_Pct", "Rank")}
            cells |= {"Share_LW": lw, "Share_TW_Exact": tw, "Share_WoW_Abs": f"{c('share_pct')} - {lw}", "Share_WoW_Abs_Exact": f"{tw} - {lw}", "Units_Share": over(c("units_tw"), "t.units_tw") + " * 100", "Orders_Share": over(c("orders_tw"), "t.orders_tw") + " * 100"}
        source = "totals t" if total else "report r join totals t using (week)"
        parts += [f"select week, {chr(39) + 'TOTAL' + chr(39) if total else 'r.entity'} as entity, '{x}' as col, {v} as value from {source} where {v} is not null" for x, v in cells.items()]
    return BASE.rstrip() + ",\n" + TOTALS + " " + " union all ".join(parts)


def extract_numbers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every document."""
    found = mentions(note_lines(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("note_id"), F.lit("").alias("table_id"), F.col("text").alias("note"))))
    return found.select(F.col("note_id").cast("long").alias("doc_id"), "line_idx", "mention_idx", "raw_text", "value", "unit", "direction", "qualifier", "skip_reason", "position")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.sum((F.col("c_acctbal") < 0).cast("long")).alias("num"), F.count(F.lit(1)).alias("den"))


def _reviews(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    verdict = F.when(F.pmod(F.col("c_custkey") * (2 * k + 3), F.lit(7 + k)) < 3, "wrong").otherwise("right")
    rows = table(spark, sf_dir, "customer").select("c_custkey", verdict.alias("verdict"))
    return rows.where("c_custkey % 5 > 0") if k == 2 else rows


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The discounts of an order's lines as the rates of its rounds."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_discount", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("at"), F.col("l_discount").cast("decimal(18,2)").alias("value"))


ROUNDS_SQL = "with o as (select l_orderkey, row_number() over (partition by l_orderkey order by l_discount, l_extendedprice) as k, cast(l_discount as decimal(18,2)) as value from lineitem)"


def spoilt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a report in which some derived values have been spoilt, found by working them out again."""
    spoilt = lambda c, pos, digit, by: F.when((F.col("pos") == pos) & F.col("week").endswith(digit), F.col(c) + by).otherwise(F.col(c))
    report_ = _report(spark, sf_dir).withColumns({"wow_pct": spoilt("wow_pct", 2, "5", 1.0), "share_pct": spoilt("share_pct", 3, "7", 0.2)})
    return reports.not_recomputing(report_).select("week", "entity", "stored_wow_pct", "wow_pct", "stored_share_pct", "share_pct")


INVARIANTS_SQL = """again as (select *, case when revenue_lw > 0 then round_even((revenue_tw - revenue_lw) / revenue_lw * 100 * 10, 0) / 10 end as wow, case when revenue_ly > 0 then round_even((revenue_tw - revenue_ly) / revenue_ly * 100 * 10, 0) / 10 end as yoy,
  round_even(revenue_tw / cast(sum(cast(revenue_tw as decimal(18,2))) over (partition by week) as double) * 100 * 10, 0) / 10 as share, rank() over (partition by week order by revenue_tw desc) as place from given),
bad as (select * from again where not ((wow_pct is not distinct from wow or abs(wow_pct - wow) < 1e-6) and (yoy_pct is not distinct from yoy or abs(yoy_pct - yoy) < 1e-6) and (share_pct is not distinct from share or abs(share_pct - share) < 1e-6) and "rank" = place))"""


QUERIES = {
    "spoilt_rows": spoilt_rows,
    "clean_lines": lambda s, d: reports.clean_lines(s, d).select("invoice_no", "day", "country", "product", "brand", "quantity", F.col("revenue").cast("double").alias("revenue"), "flag"),
    "weekly_rollup_country": lambda s, d: reports.weekly_sales(s, d, "country"),
    "weekly_rollup_product": lambda s, d: reports.weekly_sales(s, d, "product"),
    "eligible_weeks": lambda s, d: reports.eligible_weeks(reports.clean_lines(s, d)),
    "report_all_weeks": _report,
    "report_products": lambda s, d: _report(s, d, "product"),
    "report_invariants": _on_report(lambda r: reports.not_recomputing(r).agg(F.count(F.lit(1)).alias("n_bad"))),
    "dedupe_sheet_overlap": lambda s, d: reports.without_overlap(
        table(s, d, "orders").where("o_orderdate < '1998-06-01'").select("o_orderkey", "o_custkey"), table(s, d, "orders").where("o_orderdate >= '1998-01-01'").select("o_orderkey", "o_custkey"), "o_custkey"
    ),
    "condition_grid": lambda s, d: table(s, d, "region").select("r_name").crossJoin(s.createDataFrame([("S1",), ("S2",), ("S3",), ("S4",)], "strategy string")).crossJoin(s.range(1, 3).select(F.col("id").alias("repeat"))),
    "resume_anti_join": lambda s, d: table(s, d, "customer").select("c_custkey").join(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"),
    "cell_unpivot": _on_report(candidates.cells),
    "column_aggregates": _on_report(candidates.column_aggregates),
    "period_totals": _on_report(candidates.period_totals),
    "topk_cumulative": _on_report(candidates.topk_cumulative),
    "per_order_unit": _on_report(candidates.per_order_unit),
    "entity_changes": _on_report(candidates.entity_changes),
    "entity_shares": _on_report(candidates.entity_shares),
    "pairwise_diffs": _on_report(candidates.pairwise),
    "family_groups": lambda s, d: candidates.families(_report(s, d, "product")),
    "match_predicate": match_predicate,
    "level1_labels": level1_labels,
    "level1_rates": lambda s, d: gate.note_rates(_level1(s, d)),
    "extract_numbers_docs": extract_numbers_docs,
    "claim_labels": claim_labels,
    "claim_frame": claim_cells,
    "rates_grouping_sets": lambda s, d: evaluation.rates_by_sets(_verdicts(s, d), SETS, "num", "den"),
    "cluster_bootstrap": lambda s, d: evaluation.bootstrap(_clusters(s, d), "num", "den", "n_name", 500),
    "paired_bootstrap": lambda s, d: evaluation.paired_difference(_segments(s, d), ["n_name"], "c_mktsegment", "BUILDING", "MACHINERY", 300),
    "reviewer_consensus": lambda s, d: evaluation.consensus(*[_reviews(s, d, k) for k in range(3)], "c_custkey"),
    "markdown_tables": _on_report(lambda r: text_functions.markdown(r, "week", ["pos"], ["entity", "units_tw", "orders_tw", "rank"])),
    "markdown_round_trip": _on_report(
        lambda r: text_functions.from_markdown(text_functions.markdown(r, "week", ["pos"], ["entity", "units_tw", "orders_tw", "rank"]), "week", "markdown").where("pos > 0").select(
            "week", F.col("cells")[0].alias("entity"), F.col("cells")[1].cast("long").alias("units_tw"), F.col("cells")[3].cast("long").alias("rank")
        )
    ),
    "cache_keys": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text_functions.cache_key(F.col("role"), F.coalesce("text", F.lit(""))).alias("key")),
    "holm": lambda s, d: evaluation.holm(_tests(s, d)),
    "kappa": lambda s, d: evaluation.kappa(table(s, d, "customer").select((F.col("c_acctbal") > 0).cast("int").alias("a"), (F.pmod("c_custkey", F.lit(3)) > 0).cast("int").alias("b")), "a", "b"),
    "wilson": lambda s, d: _clusters(s, d).select("n_name", *[x.alias(n) for x, n in zip(evaluation.wilson(F.col("num"), F.col("den")), ("low", "high"), strict=True)]),
    "stratified_audit_sample": lambda s, d: evaluation.stratified(table(s, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 7, "audit").select("c_mktsegment", "c_custkey", F.col("pick").cast("long").alias("pick")),
    "precision_recall": lambda s, d: evaluation.precision_recall(table(s, d, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("found")), "truth", "found"),
    "span_overlap_alignment": best_spans,
    "report_facts": _on_report(reports.facts),
    "rounds_carried_forward": lambda s, d: evaluation.carried_forward(_rounds(s, d), "l_orderkey", "at", "value"),
    "repeats_side_by_side": lambda s, d: evaluation.side_by_side(_rounds(s, d), ["l_orderkey"], "at", "value", {1: "first", 2: "second"}).select("l_orderkey", F.col("first").cast("double").alias("first"), F.col("second").cast("double").alias("second")),
    "review_batches": lambda s, d: evaluation.review_batches(table(s, d, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 25, 10, "review"),
}

ORACLES = {
    "claim_frame": frame_sql(),
    "clean_lines": with_(LINES) + "select invoice_no, day, country, product, brand, quantity, cast(revenue as double) as revenue, flag from clean",
    "weekly_rollup_country": with_(LINES, weekly("country")) + "select * from weekly",
    "weekly_rollup_product": with_(LINES, weekly("product")) + "select * from weekly",
    "eligible_weeks": with_(LINES, "good as (select week, week_start, count(distinct day) as n_days from clean group by all having count(distinct day) >= 4)") + "select week, week_start, n_days from good g where exists (select 1 from good b where b.week_start + 7 = g.week_start)",
    "report_all_weeks": BASE + f"select {REPORT_COLUMNS} from report",
    "report_products": with_(LINES, weekly("product"), report(TOP)) + f"select {REPORT_COLUMNS} from report",
    "report_invariants": BASE.rstrip() + ", given as (select * from report), " + INVARIANTS_SQL + " select count(*) as n_bad from bad",
    "spoilt_rows": BASE.rstrip() + """, given as (select * replace (case when pos = 2 and suffix(week, '5') then wow_pct + 1 else wow_pct end as wow_pct, case when pos = 3 and suffix(week, '7') then share_pct + 0.2::double else share_pct end as share_pct) from report),
        """ + INVARIANTS_SQL + " select week, entity, wow_pct as stored_wow_pct, wow as wow_pct, share_pct as stored_share_pct, share as share_pct from bad",
    "dedupe_sheet_overlap": """with a as (select * from orders where o_orderdate < '1998-06-01'), b as (select * from orders where o_orderdate >= '1998-01-01')
        select o_orderkey, o_custkey from a where not exists (select 1 from b where b.o_custkey = a.o_custkey) union all select o_orderkey, o_custkey from b""",
    "condition_grid": "select r_name, strategy, repeat from region, (values ('S1'), ('S2'), ('S3'), ('S4')) s(strategy), (values (1::bigint), (2::bigint)) r(repeat)",
    "resume_anti_join": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "cell_unpivot": BASE.rstrip() + ",\n" + CELLS + " select week, entity, col, value, unit from cells",
    "column_aggregates": BASE.rstrip() + ",\n" + CELLS + """, g as (select week, col, unit, cast(sum(cast(value as decimal(18,2))) as double) as s, count(value) as n, median(value) as md, max(value) as mx, min(value) as mn
        from cells where unit <> 'rank' group by week, col, unit), u as (select week, unit, 'sum' as op, col, s as value from g union all select week, unit, 'mean', col, s / n from g union all select week, unit, 'median', col, md from g
        union all select week, unit, 'max', col, mx from g union all select week, unit, 'min', col, mn from g)
        select week, op || '(' || col || ')' as evidence, value, unit from u where unit <> 'percent' or op in ('mean', 'max', 'min')""",
    "period_totals": BASE.rstrip() + ",\n" + TOTALS + " " + _changes_sql("totals", "week", "{op}(sum {m}_tw, sum {m}_{p})", True),
    "topk_cumulative": BASE.rstrip() + """, r as (select week, row_number() over o as k, sum(cast(revenue_tw as decimal(18,2))) over (o rows unbounded preceding) as top,
        sum(cast(revenue_tw as decimal(18,2))) over (partition by week) as total from report window o as (partition by week order by revenue_tw desc, entity))
        select week, cast(k as integer) as k, cast(top as double) as sum_topk, cast(top as double) / cast(total as double) * 100 as share_topk, cast(total - top as double) as sum_after,
        cast(total - top as double) / cast(total as double) * 100 as share_after from r where k <= 10""",
    "per_order_unit": BASE.rstrip() + ",\n" + TOTALS + """, p as (select week, revenue_tw / nullif(orders_tw, 0) as per_order_tw, revenue_lw / nullif(orders_lw, 0) as per_order_lw, revenue_tw / nullif(units_tw, 0) as per_unit_tw,
        revenue_lw / nullif(units_lw, 0) as per_unit_lw, units_tw / nullif(orders_tw, 0) as units_per_order_tw, units_lw / nullif(orders_lw, 0) as units_per_order_lw from totals)
        select *, (per_order_tw - per_order_lw) / nullif(per_order_lw, 0) * 100 as per_order_change, (per_unit_tw - per_unit_lw) / nullif(per_unit_lw, 0) * 100 as per_unit_change,
        (units_per_order_tw - units_per_order_lw) / nullif(units_per_order_lw, 0) * 100 as units_per_order_change from p""",
    "entity_changes": BASE + _changes_sql("report", "week, entity", "{op}({m}_{p})", False),
    "entity_shares": BASE.rstrip() + ",\n" + TOTALS + " select r.week, r.entity, "
    + ", ".join(f"cast(r.{c} as double) / nullif(t.{c}, 0) * 100 as share_{c}" for c in ("revenue_tw", "revenue_lw", "units_tw", "units_lw", "orders_tw", "orders_lw"))
    + ", cast(r.revenue_tw as double) / nullif(t.revenue_tw, 0) * 100 - cast(r.revenue_lw as double) / nullif(t.revenue_lw, 0) * 100 as share_change_pp, r.revenue_tw / (t.revenue_tw / n_rows) as ratio_to_mean, t.revenue_tw - r.revenue_tw as sum_excluding from report r join totals t using (week)",
    "pairwise_diffs": BASE + "select x.week, x.entity as a, y.entity as b, x.revenue_tw - y.revenue_tw as diff, (x.revenue_tw - y.revenue_tw) / y.revenue_tw * 100 as pct_change, x.revenue_tw / y.revenue_tw as ratio from report x join report y on x.week = y.week and x.entity <> y.entity",
    "family_groups": with_(LINES, weekly("product"), report(TOP)).rstrip() + """, w as (select week, entity, revenue_tw, regexp_extract_all(lower(entity), '[a-z]+') as w from report),
        g as (select distinct week, entity, revenue_tw, fragment from (select week, entity, revenue_tw, unnest(flatten([[array_to_string(w[i:i + n - 1], ' ') for i in range(1, greatest(len(w) - n + 1, 1) + 1)] for n in [1, 2, 3]])) as fragment from w where len(w) > 0)),
        f as (select week, fragment, count(*) as members, cast(sum(cast(revenue_tw as decimal(18,2))) as double) as revenue from g group by week, fragment having count(*) between 2 and 20),
        t as (select week, cast(sum(cast(revenue_tw as decimal(18,2))) as double) as total from report group by week) select week, fragment, members, revenue, revenue / total * 100 as share from f join t using (week)""",
    "match_predicate": MATCH_SQL,
    "rates_grouping_sets": """with v as (select l_linestatus as strategy, cast(quarter(l_shipdate) as varchar) as size, cast(l_returnflag = 'R' as bigint) as num, 1 as den from lineitem)
        select strategy, size, count(*) as n, cast(sum(num) as double) / nullif(sum(den), 0) as rate from v group by grouping sets ((), (strategy), (size), (strategy, size))""",
    "cluster_bootstrap": f"""with c as (
  select n_name, sum(cast(c_acctbal < 0 as bigint)) as num, count(*) as den from customer join nation on c_nationkey = n_nationkey group by n_name),
{weighed("c", 500, "n_name")},
x as (select b, sum(w * num)::double / nullif(sum(w * den), 0)::double as rate from drawn group by b)
select count(rate) as rounds, quantile_cont(rate, 0.025) as low, quantile_cont(rate, 0.975) as high from x""",
    "paired_bootstrap": f"""with g as (
  select n_name, c_mktsegment as arm, sum(cast(c_acctbal < 0 as bigint))::double as num, count(*)::double as den
  from customer join nation on c_nationkey = n_nationkey group by all),
u as (select a.n_name, a.num as na, a.den as da, b.num as nb, b.den as db
  from g a join g b on a.n_name = b.n_name and a.arm = 'BUILDING' and b.arm = 'MACHINERY'),
whole as (select count(*) as n, sum(na) / sum(da) - sum(nb) / sum(db) as difference from u),
{weighed("u", 300, "n_name")},
x as (select b, sum(w * na) / nullif(sum(w * da), 0) - sum(w * nb) / nullif(sum(w * db), 0) as d from drawn group by b)
select n, difference, quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high,
  least(1.0::double, 2 * least(avg(cast(d <= 0 as integer)), avg(cast(d >= 0 as integer)))) as p_value
from x, whole where d is not null group by n, difference""",
    "reviewer_consensus": """with v as (select c_custkey, case when c_custkey * 3 % 7 < 3 then 'wrong' else 'right' end as a, case when c_custkey * 5 % 8 < 3 then 'wrong' else 'right' end as b,
        case when c_custkey % 5 > 0 then case when c_custkey * 7 % 9 < 3 then 'wrong' else 'right' end end as c from customer), f as (select *, case when a = b then a else c end as final from v)
        select c_custkey, final, a = b as agree, final is null as "open" from f""",
    "markdown_tables": BASE + """select week, '| entity | units_tw | orders_tw | rank |' || chr(10) || '|---|---|---|---|' || chr(10) ||
        string_agg('| ' || entity || ' | ' || units_tw || ' | ' || orders_tw || ' | ' || "rank" || ' |', chr(10) order by pos) as markdown from report group by week""",
    "markdown_round_trip": BASE + 'select week, entity, units_tw, "rank" from report',
    "cache_keys": "select conv_id, turn, sha256(length(role) || ':' || role || length(coalesce(text, '')) || ':' || coalesce(text, '')) as key from conversations",
    "holm": """with t as (select n_name as name, sum(cast(c_acctbal < 0 as bigint))::double / count(*) / 4 as p from customer join nation on c_nationkey = n_nationkey group by n_name),
        r as (select *, row_number() over (order by p, name) as rn, count(*) over () as m from t) select name, p, max(least(1.0::double, (m - rn + 1) * p)) over (order by p, name rows unbounded preceding) as p_holm from r""",
    "kappa": """with m as (select avg(cast((c_acctbal > 0) = (c_custkey % 3 > 0) as integer)) as agree, avg(cast(c_acctbal > 0 as integer)) as pa, avg(cast(c_custkey % 3 > 0 as integer)) as pb from customer)
        select agree, case when pa * pb + (1 - pa) * (1 - pb) < 1 then (agree - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) end as kappa from m""",
    "wilson": """with t as (select n_name, sum(cast(c_acctbal < 0 as bigint))::double as k, count(*)::double as n, 1.959963984540054::double as z from customer join nation on c_nationkey = n_nationkey group by n_name),
        x as (select n_name, (k / n + z * z / (2 * n)) / (1 + z * z / n) as mid, z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) as half from t) select n_name, mid - half as low, mid + half as high from x""",
    "stratified_audit_sample": "select c_mktsegment, c_custkey, pick from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by md5('audit|' || c_custkey), c_custkey) as pick from customer) where pick <= 7",
    "precision_recall": """with v as (select l_returnflag as t, case when l_linestatus = 'O' then 'N' else 'R' end as f from lineitem), l as (select distinct t as label from v union select distinct f from v),
        c as (select label, count(*) filter (t = label and f = label) as tp, count(*) filter (f = label) as n_found, count(*) filter (t = label) as n_true from l, v group by label)
        select *, tp / nullif(n_found, 0) as precision, tp / nullif(n_true, 0) as recall from c""",
    "span_overlap_alignment": SPANS_SQL,
    "report_facts": BASE.rstrip() + """, r as (select *, row_number() over (partition by week order by revenue_tw desc, entity) as a, row_number() over (partition by week order by wow_pct desc nulls last, entity) as b,
        row_number() over (partition by week order by wow_pct nulls last, entity) as c, row_number() over (partition by week order by orders_tw desc, entity) as d from report)
        select week, 'top' as fact, a as n, entity, cast(revenue_tw as double) as value from r where a <= 3 union all select week, 'up', b, entity, cast(wow_pct as double) from r where b <= 3 and wow_pct > 0
        union all select week, 'down', c, entity, cast(wow_pct as double) from r where c <= 3 and wow_pct < 0 union all select week, 'most_orders', d, entity, cast(orders_tw as double) from r where d = 1""",
    "rounds_carried_forward": ROUNDS_SQL + """, l as (select l_orderkey, max(k) as last, arg_max(value, k) as final from o group by l_orderkey), g as (select unnest(range(1, (select max(last) + 1 from l))) as round)
        select round, count(*) as n, cast(sum(coalesce(o.value, l.final)) as double) / count(*) as mean from g cross join l left join o on o.l_orderkey = l.l_orderkey and o.k = g.round group by round""",
    "repeats_side_by_side": ROUNDS_SQL + " select a.l_orderkey, cast(a.value as double) as first, cast(b.value as double) as second from o a join o b on a.l_orderkey = b.l_orderkey and a.k = 1 and b.k = 2",
    "review_batches": """select c_mktsegment, c_custkey, md5('review|item|' || c_custkey) as item_id, (pick - 1) // 10 as batch
        from (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by md5('review|' || c_custkey), c_custkey) as pick from customer) where pick <= 25""",
}

for part in (evaluation_queries, gate_queries, sentence_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
