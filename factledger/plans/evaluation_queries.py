"""Queries over labels, samples, resampling, study design and cleaning, on the star schema, and their DuckDB equivalents.

Order lines stand in for numbers and claims, nations for tables, market segments for arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.functions import text as text_functions
from factledger.operators import claims as claim_operators
from factledger.operators import cleaning, design, evaluation, outcomes, replicates, reports
from factledger.plans.report_sql import LINES, weekly, weighed, with_
from factledger.sources import files, runs
from factledger.sources.runs import filled
from factledger.sources.scratch import new_path
from factledger.sources.tables import table

LINE = ["note_id", "line_idx"]


def _pick(column: str, values: dict[str, str], otherwise: str | None = None) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in values.items():
        out = out.when(F.col(column) == k, v)
    return out.otherwise(otherwise)


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("note_id"), F.pmod("l_linenumber", F.lit(2)).alias("line_idx"), "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity").cast("long") % 4).cast("string").alias("raw_text"), "l_returnflag")
    at = F.expr("row_number() over (partition by note_id, line_idx order by l_partkey, l_suppkey, l_extendedprice) * 10").cast("long")
    return item.select(*LINE, at.alias("position"), "raw_text", _pick("l_returnflag", {"R": "Unsupported", "A": "Supported_cell"}, "Supported_derived").alias("label"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("note_id"), F.pmod("l_linenumber", F.lit(2)).alias("line_idx"), "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", (F.col("l_quantity").cast("long") % 4).cast("string").alias("q"))
    at = F.expr("row_number() over (partition by note_id, line_idx order by l_suppkey, l_partkey, l_extendedprice) - 1").cast("long")
    label = F.when(F.col("l_discount") < 0.035, "Wrong_value").when(F.col("l_discount") < 0.065, "Correct").otherwise("Unverifiable")
    return item.select(*LINE, at.alias("claim_idx"), F.when(F.col("l_suppkey") % 2 == 0, F.col("q")).otherwise(F.concat(F.lit("£"), "q")).alias("value_text"), label.alias("label"))


NUMBERS = """numbers as (select l_orderkey as note_id, l_linenumber % 2 as line_idx, row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_partkey, l_suppkey, l_extendedprice) * 10 as position,
  cast(cast(l_quantity as bigint) % 4 as varchar) as raw_text, case l_returnflag when 'R' then 'Unsupported' when 'A' then 'Supported_cell' else 'Supported_derived' end as label from lineitem),
claims as (select l_orderkey as note_id, l_linenumber % 2 as line_idx, row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_suppkey, l_partkey, l_extendedprice) - 1 as claim_idx,
  case when l_suppkey % 2 = 0 then '' else '£' end || cast(cast(l_quantity as bigint) % 4 as varchar) as value_text, case when l_discount < 0.035 then 'Wrong_value' when l_discount < 0.065 then 'Correct' else 'Unverifiable' end as label from lineitem where l_linestatus = 'F')"""


def _aligned(which: str, taken: str) -> str:
    return f"""looks as (select note_id, line_idx, position, {taken} as taken, unnest(['t' || raw_text, 'd' || raw_text]) as look from numbers),
free as (select *, min(position) over (partition by note_id, line_idx, look) as first, row_number() over (partition by note_id, line_idx, look, taken order by position) as k from looks),
asked as (select *, row_number() over (partition by note_id, line_idx, look order by claim_idx) as k from (select c.*, case when exists (select 1 from numbers n where n.note_id = c.note_id and n.line_idx = c.line_idx and n.raw_text = c.value_text)
  then 't' || value_text else 'd' || replace(value_text, '£', '') end as look from claims c where {which})),
found as (select a.note_id, a.line_idx, a.claim_idx, coalesce(f.position, g.first) as position from asked a join (select distinct note_id, line_idx, look, first from free) g using (note_id, line_idx, look)
  left join free f on f.note_id = a.note_id and f.line_idx = a.line_idx and f.look = a.look and f.k = a.k and not f.taken)"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of both levels beside what is true, on order lines."""
    item = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long")
    l1 = F.when(q % 5 == 0, None).when(q % 5 == 1, "Skipped").when(q % 5 < 4, "Unsupported").otherwise("Supported_cell")
    truth = F.element_at(F.array(*map(F.lit, TRUTHS)), (F.pmod("l_partkey", F.lit(len(TRUTHS))) + 1).cast("int"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.pmod("l_suppkey", F.lit(len(LABELS))) + 1).cast("int"))
    return item.select(F.col("l_orderkey").alias("note_id"), _pick("l_returnflag", {"A": "C", "R": "W"}, "N").alias("t1"), l1.alias("label1"), truth.alias("truth"), label.alias("gate_label"), "l_linestatus")


TRUTHS = ["Correct", "Wrong_value", "Group_correct", "Group_wrong", "Unverifiable", "Wrong_direction", "Correct"]
LABELS = ["Correct", "Correct", "Wrong_value", "Wrong_entity", "Unverifiable"]
TRUTH = f"""t as (select l_orderkey as note_id, case l_returnflag when 'A' then 'C' when 'R' then 'W' else 'N' end as t1, case when cast(l_quantity as bigint) % 5 = 0 then null when cast(l_quantity as bigint) % 5 = 1 then 'Skipped'
  when cast(l_quantity as bigint) % 5 < 4 then 'Unsupported' else 'Supported_cell' end as label1, {TRUTHS}[cast(l_partkey % {len(TRUTHS)} + 1 as integer)] as truth, {LABELS}[cast(l_suppkey % {len(LABELS)} + 1 as integer)] as gate_label, l_linestatus from lineitem)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes of a run."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("note_id"), F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("model"), (F.pmod(key, F.lit(11)) == 0).alias("failed"), F.pmod(key, F.lit(7)).alias("n_unsupported"), (F.pmod(key, F.lit(7)) + F.pmod(key, F.lit(5))).alias("n_checked"),
        F.pmod(key, F.lit(3)).alias("n_wrong"), (F.pmod(key, F.lit(3)) + F.pmod(key, F.lit(4))).alias("n_verifiable"), F.col("o_totalprice").cast("decimal(18,2)").alias("cost"), (F.col("o_totalprice").cast("decimal(18,2)") / 8).cast("decimal(20,4)").alias("latency"),
    )


NOTES = """notes as (select o_orderkey as note_id, o_orderpriority as strategy, o_orderstatus as model, o_orderkey % 11 = 0 as failed, o_orderkey % 7 as n_unsupported, o_orderkey % 7 + o_orderkey % 5 as n_checked, o_orderkey % 3 as n_wrong,
  o_orderkey % 3 + o_orderkey % 4 as n_verifiable, cast(o_totalprice as decimal(18,2)) as cost, cast(cast(o_totalprice as decimal(18,2)) / 8 as decimal(20,4)) as latency from orders)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "n_nationkey", "n_regionkey", "c_mktsegment").agg(F.sum((F.col("c_acctbal") < 0).cast("long")).alias("num"), F.count(F.lit(1)).alias("den"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).groupBy("n_name", "n_regionkey").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


SEGMENTS = "seg as (select n_name, n_nationkey, n_regionkey, c_mktsegment, sum(cast(c_acctbal < 0 as bigint)) as num, count(*) as den from customer join nation on c_nationkey = n_nationkey group by all), nat as (select n_name, n_regionkey, sum(num) as num, sum(den) as den from seg group by all)"
ARMS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's segments as rounds; a nation that ends early keeps its last one."""
    at = F.array_position(F.array(*map(F.lit, ARMS)), F.col("c_mktsegment"))
    own = _segments(spark, sf_dir).withColumn("rnd", at).where("rnd > 0 and rnd <= 1 + n_nationkey % 5").select("n_name", "rnd", (F.col("num") / F.col("den")).alias("value"))
    return evaluation.padded(own, "n_name", "rnd", "value", len(ARMS))


ROUNDS = f"""own as (select n_name, list_position({ARMS}, c_mktsegment) as rnd, num / den as value, n_nationkey from seg where list_position({ARMS}, c_mktsegment) <= 1 + n_nationkey % 5),
pad as (select n_name, rnd, value from own union all select u.n_name, r.rnd, u.final from (select n_name, max(rnd) as last_rnd, arg_max(value, rnd) as final from own group by n_name) u, range(1, 6) r(rnd) where r.rnd > u.last_rnd)"""


def _draws(n: str, *parts: str) -> str:
    return f"('0x' || md5({' || chr(124) || '.join(f'cast({p} as varchar)' for p in parts)})[1:15])::bigint % {n}"


def _raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the faults that raw sales have."""
    s = reports.sales_lines(spark, sf_dir)
    key = F.col("invoice_no")
    return s.select(
        F.concat(F.when(F.col("flag") == "R", "C").otherwise(""), key.cast("string")).alias("invoice_no"), F.when(key % 13 == 0, "POST").otherwise(F.format_string("%05dA", F.pmod(key, F.lit(100000)))).alias("stock_code"),
        F.when(key % 17 == 0, " nan ").when(key % 19 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("product"))).alias("description"), (F.col("quantity") - 1).alias("quantity"), F.col("revenue").alias("unit_price"),
        F.when(key % 23 == 0, "Unspecified").when(key % 29 == 0, None).otherwise(F.col("country")).alias("country"),
    )


RAW = """raw as (select case when flag = 'R' then 'C' else '' end || invoice_no as invoice_no, case when invoice_no % 13 = 0 then 'POST' else printf('%05d', invoice_no % 100000) || 'A' end as stock_code,
  case when invoice_no % 17 = 0 then ' nan ' when invoice_no % 19 = 0 then '  ' else ' ' || lower(product) end as description, quantity - 1 as quantity, revenue as unit_price,
  case when invoice_no % 23 = 0 then 'Unspecified' when invoice_no % 29 = 0 then null else country end as country from lines),
marked as (select *, not starts_with(invoice_no, 'C') as not_cancelled, quantity > 0 and unit_price > 0 as positive, coalesce(country <> 'Unspecified', false) as country_known, regexp_matches(stock_code, '^[0-9]{5}') as is_product,
  upper(trim(description)) not in ('NAN', '') as described from raw)"""

PLAN = [("small", 3, 6, 12), ("medium", 8, 15, 9), ("large", 18, 40, 5)]
PRICES = [("en", 3.0, 15.0), ("de", 1.0, 5.0), ("fr", 0.25, 1.25)]


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    weekly = reports.weekly_sales(spark, sf_dir, "country")
    return weekly, design.table_plan(weekly, spark.createDataFrame(PLAN, "size string, least long, most long, tables long"), "plan")


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text_functions.cache_key(F.col("role"), F.coalesce("text", F.lit(""))).alias("key"))
    asked = c.select("key", (1000 + F.pmod("conv_id", F.lit(3)) * 500).cast("long").alias("max_tokens"))
    had = c.where("turn % 2 = 0").select("key", F.when(F.pmod("conv_id", F.lit(4)) == 0, "max_tokens").otherwise("end_turn").alias("stop_reason"), F.lit(1200).cast("long").alias("max_tokens"))
    return asked, had


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.struct(
        F.col("l_quantity").cast("long").alias("tokens_in"), F.col("l_linenumber").cast("long").alias("tokens_out"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"), F.col("l_tax").cast("decimal(18,2)").alias("latency"),
        F.when(F.col("l_discount") > 0.095, "refusal").otherwise("end_turn").alias("stop_reason"),
    )
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(call).alias("calls"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as drafts and final notes: the draft's text is the status, the final one's the priority's first
    letter or the status."""
    o = table(spark, sf_dir, "orders").join(_traces(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    part = o.groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("arm")).agg(F.min_by("o_orderstatus", "o_orderkey").alias("note"), F.min_by("calls", "o_orderkey").alias("calls"))
    return part.select("o_custkey", F.when(F.col("arm") == 0, "S1").otherwise("S3").alias("strategy"), "note", "calls")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.pmod("l_partkey", F.lit(n))
    item = table(spark, sf_dir, "lineitem")
    evidence = F.element_at(F.array(*map(F.lit, EVIDENCE)), (k(len(EVIDENCE)) + 1).cast("int"))
    return item.select(
        evidence.alias("evidence"), F.when(F.col("l_returnflag") == "R", "Wrong_entity").otherwise("Wrong_value").alias("label"), F.when(F.col("l_suppkey") % 6 == 0, "Total").when(F.col("l_suppkey") % 6 == 1, "").otherwise("x").alias("entity"),
        F.when(F.col("l_linenumber") % 2 == 0, "TW").otherwise("WoW").alias("period"), F.when(F.col("l_quantity") > 40, "The lines combined").otherwise("plain").alias("line"),
    )


EVIDENCE = ["direction wrong", "value is A.Revenue_LW=3, claimed Revenue_WoW_Abs", "value is A.Units_TW=3, claimed Orders_TW", "it belongs to B", "nothing near"]

WORDS = {"1996": "<year>", "1996-0": "<month>"}


QUERIES = {
    "claim_numbers": lambda s, d: outcomes.claim_numbers(numbers(s, d), claims(s, d)),
    "gate_flags": lambda s, d: outcomes.gate_flags(numbers(s, d), claims(s, d)).select(*LINE, "position", F.col("flag").cast("long").alias("flag")),
    "outcomes_level1": lambda s, d: _truth(s, d).select("t1", outcomes.level1_outcome(F.col("t1"), F.col("label1")).alias("outcome")).groupBy("t1", "outcome").agg(F.count(F.lit(1)).alias("n")),
    "outcomes_level2": lambda s, d: _truth(s, d).select("truth", outcomes.level2_outcome(F.col("truth"), F.col("gate_label")).alias("outcome")).groupBy("truth", "outcome").agg(F.count(F.lit(1)).alias("n")),
    "truth_with_gate_label": lambda s, d: outcomes.with_gate_label(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label")), ["o_orderkey"]),
    "note_outcomes": lambda s, d: outcomes.note_outcomes(_truth(s, d)),
    "truth_crosstab": lambda s, d: outcomes.crosstab(_truth(s, d), "truth", "gate_label", sorted(set(LABELS))),
    "worst_notes": lambda s, d: outcomes.worst_notes(_notes(s, d), "strategy", "n_unsupported", "note_id"),
    "primary_tables": lambda s, d: outcomes.primary(table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey"),
    "notes_with_error": lambda s, d: outcomes.notes_with_error(table(s, d, "lineitem").select(F.col("l_linestatus").alias("arm"), F.col("l_orderkey").alias("note_id"), (F.col("l_returnflag") == "R").cast("long").alias("confirmed")), "arm"),
    "substituted_lines": lambda s, d: outcomes.substituted(
        table(s, d, "part").select(F.col("p_partkey").alias("note_id"), F.lit(0).alias("line_idx"), F.concat("p_name", F.lit(" costs "), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_partkey").cast("string")).alias("line")),
        table(s, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("note_id"), F.lit(0).alias("line_idx"), F.explode(F.array(
            F.struct((F.char_length("p_name") + 7).alias("position"), (F.char_length("p_name") + 7 + F.char_length(F.col("p_size").cast("string"))).alias("end"), F.lit("a thousand").alias("text")),
            F.struct((F.char_length("p_name") + 11 + F.char_length(F.col("p_size").cast("string"))).alias("position"), (F.char_length("p_name") + 11 + F.char_length(F.col("p_size").cast("string")) + F.char_length(F.col("p_partkey").cast("string"))).alias("end"), F.lit("7").alias("text")),
        )).alias("x")).select("note_id", "line_idx", "x.*"),
    ),
    "highlighted_lines": lambda s, d: outcomes.highlighted(
        table(s, d, "part").select(F.col("p_partkey").alias("note_id"), F.lit(0).alias("line_idx"), F.concat(F.lit("<"), "p_name", F.lit("> & more")).alias("line")),
        table(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("note_id"), F.lit(0).alias("line_idx"), F.explode(F.array(F.struct(F.lit(1).alias("position"), F.lit(4).alias("end")), F.struct(F.lit(3).alias("position"), F.lit(6).alias("end")))).alias("x")).select("note_id", "line_idx", "x.*"),
    ),
    "version_overlay": lambda s, d: outcomes.version_overlay(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "Unsupported").otherwise("Supported_cell").alias("label")), table(s, d, "orders").where("o_orderkey % 7 > 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "Unsupported").alias("label")), ["o_orderkey"]),
    "review_overlay": lambda s, d: outcomes.review_overlay(table(s, d, "orders").select("o_orderkey"), table(s, d, "orders").where("o_orderkey % 4 > 0").select("o_orderkey", _pick("o_orderstatus", {"F": "correct", "O": "wrong", "P": "unclear"}).alias("final")), ["o_orderkey"]).select("o_orderkey", F.col("code").cast("long").alias("code")),
    "same_as_draft": lambda s, d: outcomes.same_as_draft(_texts(s, d), ["o_custkey"], "strategy", "S3", "S1"),
    "trace_totals": lambda s, d: outcomes.trace_totals(_traces(s, d), "l_orderkey").select("l_orderkey", F.col("n_calls").cast("long").alias("n_calls"), "tokens_in", "tokens_out", "cost", "latency"),
    "flag_causes": lambda s, d: _evidence(s, d).select(outcomes.cause(*[F.col(c) for c in ("evidence", "label", "entity", "period", "line")]).alias("cause")).groupBy("cause").agg(F.count(F.lit(1)).alias("n")),
    "error_kinds": lambda s, d: outcomes.crosstab(table(s, d, "lineitem").where("l_discount > 0.05").select("l_linestatus", "l_returnflag"), "l_linestatus", "l_returnflag", ["A", "N", "R"]),
    "audit_union": lambda s, d: numbers(s, d).where("label = 'Unsupported'").select(F.lit("number").alias("item_type"), *LINE, F.col("raw_text").alias("item"), "position").unionByName(claims(s, d).where("label like 'Wrong%'").select(F.lit("claim").alias("item_type"), *LINE, F.col("value_text").alias("item")), allowMissingColumns=True),
    "expected_precision": lambda s, d: _nations(s, d).select("n_name", evaluation.expected_precision(F.col("num") / F.col("den"), F.lit(0.016), F.lit(0.62)).alias("precision")),
    "run_summary": lambda s, d: evaluation.summary(_notes(s, d), ["strategy"]),
    "table_sizes": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows")).join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey").groupBy("o_orderpriority").agg(F.min("n_rows").alias("least"), F.max("n_rows").alias("most"), F.count(F.lit(1)).alias("n")),
    "round_means_bootstrap": lambda s, d: evaluation.bootstrap_means(_rounds(s, d), "rnd", "n_name", "value", 200),
    "difference_of_sets": lambda s, d: evaluation.difference_of_sets(_nations(s, d).where("n_regionkey < 2"), _nations(s, d).where("n_regionkey >= 2"), "num", "den", "n_name", 300),
    "conditional_test": lambda s, d: evaluation.conditional_test(_segments(s, d), ["n_name"], "c_mktsegment", "BUILDING", "MACHINERY", 200),
    "recall_bound": lambda s, d: _nations(s, d).select("n_name", *[x.alias(n) for n, x in evaluation.recall_bound(F.col("num"), F.col("den"), F.lit(0), F.col("den") * 10).items()]),
    "detection_bootstrap": lambda s, d: evaluation.intervals(evaluation.bootstrap_many(_segments(s, d).groupBy("n_name").agg(F.sum("num").alias("a"), F.sum("den").alias("b"), F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("num")).otherwise(0)).alias("c")), {"share": ("a", "b"), "of_found": ("c", "a")}, "n_name", 300), ["share", "of_found"]),
    "audit_sample": lambda s, d: evaluation.audit_sample(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), ["c_mktsegment", "c_nationkey"], "c_custkey", 300, "audit").select("c_custkey", "c_mktsegment", "c_nationkey", F.col("extra").cast("long").alias("extra")),
    "review_items": lambda s, d: evaluation.review_items(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 83, 20, "review").select("item_id", "batch", "c_custkey", "c_mktsegment"),
    "blind_items": lambda s, d: evaluation.blind(evaluation.review_items(table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_name"), "c_mktsegment", "c_custkey", 83, 20, "review"), ["c_name"], "c_custkey")[0],
    "binary_precision_recall": lambda s, d: evaluation.binary_precision_recall(_truth(s, d), "truth", "gate_label", list(outcomes.WRONG)),
    "table_plan": lambda s, d: _plan(s, d)[1],
    "planned_rows": lambda s, d: design.planned_rows(*_plan(s, d)).select("size", "week", "entity", F.col("pos").cast("long").alias("pos"), "revenue"),
    "cache_misses": lambda s, d: design.cache_misses(*_requests(s, d)),
    "within_budget": lambda s, d: design.within_budget(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice", 500000.0).select("o_custkey", "o_orderkey", "spent_before"),
    "estimated_cost": lambda s, d: design.estimated_cost(table(s, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("text"), F.lit(400).alias("out")), s.createDataFrame(PRICES, "lang string, price_in double, price_out double"), "lang", 2),
    "usable_facts": lambda s, d: design.usable_facts(
        table(s, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, '{"facts": ').otherwise(""), F.lit('[{"value": '), F.col("user_id").cast("string"), F.lit('}, {"value": "12"}, {"value": true}, {"other": 1}, 5, {"value": '), F.round("value", 2).cast("string"), F.lit("}]"), F.when(F.col("event_id") % 2 == 0, "}").when(F.col("event_id") % 5 == 1, " x").otherwise("")).alias("reply")), "event_id", "reply"
    ).select("event_id", F.col("k").cast("long").alias("k"), "value"),
    "cleaned_sales": lambda s, d: cleaning.cleaned(_raw_lines(s, d)).select("invoice_no", "stock_code", "description", "quantity", "country", F.col("revenue").cast("double").alias("revenue")),
    "rule_counts": lambda s, d: cleaning.rule_counts(_raw_lines(s, d)),
    "csv_heads": lambda s, d: text_functions.csv_head(table(s, d, "nation").select("n_regionkey", "n_nationkey", F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ', "x"').otherwise("")).alias("name")), "n_regionkey", ["n_nationkey"], ["n_nationkey", "name"]),
    "prompts": lambda s, d: table(s, d, "nation").select("n_nationkey", filled("Week {week} of {name} ({name}), {n} rows", {"week": F.lit("2011-W42"), "name": F.col("n_name"), "n": F.col("n_regionkey")}).alias("prompt")),
    "percent_texts": lambda s, d: table(s, d, "customer").select("c_custkey", text_functions.percent(F.col("c_acctbal") / 128).alias("plain"), text_functions.percent(F.col("c_acctbal") / 128, True).alias("signed")),
    "error_texts": lambda s, d: table(s, d, "orders").select("o_orderkey", text_functions.without_paths(F.concat(F.lit("at "), F.date_format("o_orderdate", "yyyy-MM-dd")), WORDS).alias("text")),
    "note_texts": lambda s, d: table(s, d, "nation").select(
        "n_nationkey", text_functions.bullets(F.concat(F.lit("Here:\n * "), "n_name", F.lit("\n- two\nthree"))).alias("bullets"), text_functions.fenced_code(F.concat(F.lit("Try\n```python\nprint("), F.col("n_nationkey").cast("string"), F.lit(")\n```\nend"))).alias("code"),
        text_functions.number_text(F.concat(F.lit("£1,2"), F.col("n_nationkey").cast("string"), F.lit(".50k"))).alias("digits"), text_functions.well_formed(F.repeat(F.concat(F.lit("- line "), F.col("n_nationkey").cast("string"), F.lit("\n")), (F.col("n_nationkey") % 10).cast("int"))).alias("ok"),
    ),
}

QUERIES |= {
    "missing_items": lambda s, d: evaluation.missing(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"),
    "rates_six_sets": lambda s, d: evaluation.rates_by_sets(
        _notes(s, d).where("not failed").join(table(s, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.quarter("o_orderdate").cast("string").alias("size")), "note_id"),
        [[], ["strategy"], ["model"], ["size"], ["strategy", "size"], ["model", "strategy"]], "n_unsupported", "n_checked",
    ),
    "trailing_directions": lambda s, d: table(s, d, "orders").select("o_orderkey", text_functions.trailing_direction(F.concat(F.lit("£1"), _pick("o_orderstatus", {"F": " TW, down from £3", "O": " (rising on LW)", "P": ", from £3 up"})), F.lit(2)).alias("trailing")),
    "extraction_status": lambda s, d: claim_operators.extraction_status(
        table(s, d, "orders").select(F.col("o_orderkey").alias("note_id"), F.when(F.col("o_orderkey") % 5 == 0, "mock").otherwise("m").alias("model")),
        table(s, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("note_id"), F.when(F.col("o_orderkey") % 4 == 0, "no object").when(F.col("o_orderkey") % 4 == 1, '{"other": 1}').otherwise('Here: {"claims": [{"line": 0, "entity": "x"}]} end').alias("reply")),
    ),
}


def _planned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = design.planned_rows(*_plan(spark, sf_dir))
    return rows.select(F.concat_ws("_", "size", F.lit("country"), "week").alias("table_id"), "size", F.lit("country").alias("entity_type"), "week", "pos", "entity", "revenue")


def written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned tables written as files with their index, and read back: each index row beside what its file holds."""
    path, about = new_path(spark, "tables"), ["size", "entity_type", "week"]
    files.write_tables(_planned_tables(spark, sf_dir), path, about)
    index = files.read_csv(spark, f"{path}/index", "table_id string, size string, entity_type string, week string, n_rows long")
    held = files.read_tables(spark, path, "pos long, entity string, revenue double").groupBy("table_id").agg(F.max("pos").alias("last_pos"), F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return index.join(held, "table_id", "left")


QUERIES["written_tables"] = written_tables
QUERIES["resume_open_units"] = lambda s, d: evaluation.missing(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def reply_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of replies that three jobs have written one after the other, many keys more than once: a customer's orders
    as replies to one prompt, cut off where the order is open."""
    path = new_path(spark, "replies")
    limit = (F.col("o_orderkey") % 7 * 256).alias("max_tokens")
    stop = F.when(F.col("o_orderstatus") == "O", "max_tokens").otherwise("end_turn").alias("stop_reason")
    replies = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.concat(F.lit("reply "), "o_orderkey").alias("text"), stop, limit, F.pmod("o_orderkey", F.lit(3)).alias("job"))
    for k in range(3):
        runs.write_replies(replies.where(F.col("job") == k), path)
    return runs.read_replies(spark, path).select("key", "stop_reason", "max_tokens")


QUERIES["reply_store"] = reply_store

SALES = with_(LINES, RAW)
WEEKLY = with_(LINES, weekly("country")).rstrip()
CHOSEN = "plan as (select * from (values " + ", ".join(f"('{a}', {b}, {c}, {n})" for a, b, c, n in PLAN) + f""") p(size, least, most, tables)), t as (select week, count(*) as trading from weekly where revenue > 0 group by week),
k as (select size, week, least(least + {_draws('(most - least + 1)', "'plan'", "'rows'", 'size', 'week')}, trading) as n_rows, tables, row_number() over (partition by size order by md5('plan|' || size || '|' || week), week) as k from t, plan where trading >= least),
chosen as (select size, week, n_rows from k where k <= tables)"""

ORACLES = {
    "cleaned_sales": SALES + "select invoice_no, stock_code, upper(trim(description)) as description, quantity, country, cast(cast(quantity * cast(unit_price as decimal(18,4)) as decimal(24,4)) as double) as revenue from marked where not_cancelled and positive and country_known and is_product and described",
    "rule_counts": SALES + "select count(*) as n, " + ", ".join(f"count(*) filter (not {x}) as {x}" for x in ("not_cancelled", "positive", "country_known", "is_product", "described")) + " from marked",
    "table_plan": f"{WEEKLY},\n{CHOSEN} select size, week, cast(n_rows as bigint) as n_rows from chosen",
    "planned_rows": f"""{WEEKLY},\n{CHOSEN} select size, week, entity, pos, revenue from chosen join (select week, entity, revenue, row_number() over (partition by week order by revenue desc, entity) as pos from weekly where revenue > 0) using (week) where pos <= n_rows""",
    "blind_items": """with g as (select c_mktsegment, 83 // count(*) over () + cast(row_number() over (order by c_mktsegment) <= 83 % count(*) over () as bigint) as quota from (select distinct c_mktsegment from customer)),
        r as (select c_custkey, c_name, c_mktsegment, row_number() over (partition by c_mktsegment order by md5('review|' || c_custkey), c_custkey) as pick from customer), i as (select c_name, row_number() over (order by md5('review|all|' || c_custkey), c_custkey) as k from r join g using (c_mktsegment) where pick <= quota)
        select 'it' || lpad(cast(k as varchar), 4, '0') as item_id, (k - 1) // 20 + 1 as batch, c_name from i""",
    "missing_items": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
    "rates_six_sets": f"""with {NOTES}, v as (select strategy, model, cast(quarter(o_orderdate) as varchar) as size, n_unsupported as num, n_checked as den from notes join orders on o_orderkey = note_id where not failed)
        select strategy, model, size, count(*) as n, cast(sum(num) as double) / nullif(sum(den), 0) as rate from v group by grouping sets ((), (strategy), (model), (size), (strategy, size), (model, strategy))""",
    "trailing_directions": "select o_orderkey, o_orderstatus in ('F', 'O') as trailing from orders",
    "extraction_status": "select o_orderkey as note_id, case when o_orderkey % 5 = 0 then 'regex' when o_orderkey % 3 = 0 then 'budget_stop' when o_orderkey % 4 < 2 then 'extract_failed' else 'model' end as status from orders",
    "claim_numbers": f"with {NUMBERS}, {_aligned('true', 'false')} select * from found",
    "gate_flags": f"""with {NUMBERS}, {_aligned("label like 'Wrong%'", "label = 'Unsupported'")} select n.note_id, n.line_idx, n.position,
        cast(n.label = 'Unsupported' or exists (select 1 from found f where f.note_id = n.note_id and f.line_idx = n.line_idx and f.position = n.position) as bigint) as flag from numbers n""",
    "outcomes_level1": f"""with {TRUTH}, o as (select t1, case when label1 = 'Unsupported' then case t1 when 'C' then 'false_alarm' when 'W' then 'caught' else 'nm_flagged' end
        when label1 is null or label1 = 'Skipped' then case t1 when 'C' then 'correct_not_extracted' when 'W' then 'wrong_not_extracted' else 'nm_skipped' end
        else case t1 when 'C' then 'true_pass' when 'W' then 'miss' else 'nm_supported' end end as outcome from t) select t1, outcome, count(*) as n from o group by all""",
    "outcomes_level2": f"""with {TRUTH}, x as (select truth, case when gate_label like 'Wrong%' then 1 when gate_label = 'Correct' then 2 else 3 end as k from t),
        o as (select truth, case when truth = 'Correct' then ['false_alarm', 'verified', 'coverage_loss'][k] when truth like 'Wrong%' then ['detected', 'miss', 'hidden'][k] when truth = 'Group_correct' then ['group_flagged', 'group_verified', 'group_coverage_loss'][k]
        when truth = 'Group_wrong' then ['group_wrong_flagged', 'group_wrong_missed', 'group_wrong_hidden'][k] else ['unverifiable_mislabelled', 'unverifiable_mislabelled', 'unverifiable_ok'][k] end as outcome from x) select truth, outcome, count(*) as n from o group by all""",
    "truth_with_gate_label": "select o_orderkey, o_orderpriority, o_orderstatus as gate_label from orders",
    "note_outcomes": f"""with {TRUTH}, x as (select note_id, truth in ('Correct', 'Group_correct') as good, truth like 'Wrong%' or truth = 'Group_wrong' as bad, gate_label like 'Wrong%' as err from t)
        select note_id, bool_or(good and err) as false_flag, bool_or(bad) as has_error, bool_and(not bad or err) as all_errors_flagged from x group by note_id""",
    "truth_crosstab": f"with {TRUTH} select truth, " + ", ".join(f"count(*) filter (gate_label = '{x}') as \"{x}\"" for x in sorted(set(LABELS))) + " from t group by truth",
    "worst_notes": f"with {NOTES} select strategy, note_id, n_unsupported from (select *, row_number() over (partition by strategy order by n_unsupported desc, note_id) as k from notes where not failed) where k = 1",
    "primary_tables": "select c_custkey, c_nationkey from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal < 0)",
    "notes_with_error": "select arm, cast(sum(has) as bigint) as k, count(*) as n from (select l_linestatus as arm, l_orderkey, max(cast(l_returnflag = 'R' as bigint)) as has from lineitem group by all) group by arm",
    "substituted_lines": "select p_partkey as note_id, 0 as line_idx, p_name || ' costs ' || case when p_partkey % 3 > 0 then 'a thousand of 7' else p_size || ' of ' || p_partkey end as line from part",
    "highlighted_lines": """select p_partkey as note_id, 0 as line_idx, case when p_partkey % 2 = 0 then '&lt;<mark title="Unsupported">' || p_name[1:3] || '</mark>' || p_name[4:] else '&lt;' || p_name end || '&gt; &amp; more' as html from part""",
    "version_overlay": """select cast(o_orderkey % 3 = 0 as integer) as old_flag, cast(o_orderkey % 7 > 0 and o_orderkey % 2 = 0 as integer) as new_flag, count(*) as n from orders group by all""",
    "review_overlay": "select o_orderkey, cast(case when o_orderkey % 4 > 0 then case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 3 else 0 end else 0 end as bigint) as code from orders",
    "same_as_draft": """with p as (select o_custkey, o_orderkey % 2 as arm, arg_min(o_orderstatus, o_orderkey) as note, min(o_orderkey) as k from orders group by all), a as (select * from p where arm = 1), b as (select * from p where arm = 0)
        select count(*) as n, count(*) filter (a.note is not distinct from b.note) as identical, count(*) filter (exists (select 1 from lineitem where l_orderkey = a.k and l_discount > 0.095)) as refusals from a left join b using (o_custkey)""",
    "trace_totals": """select l_orderkey, count(*) as n_calls, cast(sum(cast(l_quantity as bigint)) as bigint) as tokens_in, cast(sum(l_linenumber) as bigint) as tokens_out, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as cost,
        cast(sum(cast(l_tax as decimal(18,2))) as double) as latency from lineitem group by l_orderkey""",
    "flag_causes": f"""with x as (select {EVIDENCE}[cast(l_partkey % {len(EVIDENCE)} + 1 as integer)] as e, l_returnflag = 'R' as r, l_suppkey % 6 as s, l_linenumber % 2 = 0 as tw, l_quantity > 40 as q from lineitem),
        c as (select case when e = 'direction wrong' and tw then 'direction on a level' when s < 2 then 'group taken for the total' when contains(e, 'Revenue_LW') then 'level taken for a change' when contains(e, 'Units_TW') then 'noun ignored'
        when r and contains(e, 'belongs') then 'wrong entity of a list' when q then 'family bound to a member' else 'other' end as cause from x) select cause, count(*) as n from c group by cause""",
    "error_kinds": "select l_linestatus, " + ", ".join(f"count(*) filter (l_returnflag = '{x}') as \"{x}\"" for x in "ANR") + " from lineitem where l_discount > 0.05 group by l_linestatus",
    "audit_union": f"with {NUMBERS} select 'number' as item_type, note_id, line_idx, raw_text as item, position from numbers where label = 'Unsupported' union all select 'claim', note_id, line_idx, value_text, null from claims where label like 'Wrong%'",
    "expected_precision": f"with {SEGMENTS}, x as (select n_name, cast(num as double) / cast(den as double) as b from nat) select n_name, 0.62::double * b / nullif(0.62::double * b + 0.016::double * (1 - b), 0) as precision from x",
    "run_summary": f"""with {NOTES} select strategy, count(*) as n_notes, count(*) filter (failed) as n_failed, cast(sum(n_unsupported) as double) / nullif(sum(n_checked), 0) as unsupported_rate, cast(sum(n_wrong) as double) / nullif(sum(n_verifiable), 0) as claim_error_rate,
        cast(sum(cost) as double) / count(cost) as mean_cost, cast(sum(latency) as double) / count(latency) as mean_latency from notes group by strategy""",
    "table_sizes": "with x as (select l_orderkey, count(*) as n_rows from lineitem group by 1) select o_orderpriority, min(n_rows) as least, max(n_rows) as most, count(*) as n from x join orders on o_orderkey = l_orderkey group by 1",
    "round_means_bootstrap": f"""with {SEGMENTS}, {ROUNDS},
{weighed("pad", 200, "rnd", "n_name")},
m as (select rnd, b, sum(w * value) / nullif(sum(w), 0) as m from drawn group by all)
select rnd, n, mean, low, high
from (select rnd, count(*) as n, cast(sum(cast(value as decimal(28,12))) as double) / count(*) as mean from pad group by rnd)
join (select rnd, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from m group by rnd) using (rnd)""",
    "difference_of_sets": f"""with {SEGMENTS},
one as (select n_name, num::double as num, den::double as den from nat where n_regionkey < 2),
two as (select n_name, num::double as num, den::double as den from nat where n_regionkey >= 2),
{weighed("one", 300, "'first'", "n_name", name="drawn_one")},
{weighed("two", 300, "'second'", "n_name", name="drawn_two")},
g as (select y - x as d from (select b, sum(w * num) / nullif(sum(w * den), 0) as x from drawn_one group by b)
  join (select b, sum(w * num) / nullif(sum(w * den), 0) as y from drawn_two group by b) using (b))
select (select sum(num) / sum(den) from two) - (select sum(num) / sum(den) from one) as difference,
  quantile_cont(d, 0.025) as low, quantile_cont(d, 0.975) as high,
  least(1.0::double, 2 * least(avg(cast(d <= 0 as integer)), avg(cast(d >= 0 as integer)))) as p_value
from g where d is not null""",
    "conditional_test": f"""with {SEGMENTS},
u as (select a.n_name, a.num as na, a.den as da, b.num as nb, b.den as db, cast(a.num + b.num as bigint) as k, b.den / (a.den + b.den)::double as p
  from seg a join seg b on a.n_name = b.n_name and a.c_mktsegment = 'BUILDING' and b.c_mktsegment = 'MACHINERY'),
whole as (select sum(nb) / sum(db)::double - sum(na) / sum(da)::double as difference, sum(da)::double as da, sum(db)::double as db,
    sum(k)::double as events, count(*) filter (k > 0) as units_with_events,
    count(*) filter (nb / db::double > na / da::double) as up, count(*) filter (nb / db::double < na / da::double) as down from u),
terms as (select n_name, i, exp(lgamma(k + 1) - lgamma(i + 1) - lgamma(k - i + 1) + i * ln(p) + (k - i) * ln(1 - p)) as share
  from u, lateral (select unnest(range(0, k + 1)) as i) where k > 0),
steps as (select n_name, i, floor(least(sum(share) over (partition by n_name order by i), 1.0::double) * {replicates.PRIME}) as step from terms),
{weighed("u", 200, "n_name")},
s as (select d.b, count(*) as of_b from drawn d join steps t on d.n_name = t.n_name and t.i < d.k and t.step <= d.x group by d.b),
each as (select r.b, coalesce(of_b, 0) as of_b from range(200) r(b) left join s using (b)),
f as (select count(*) as far from each, whole where abs(of_b / db - (events - of_b) / da) >= abs(difference) - 1e-12::double)
select difference, (far + 1) / 201.0::double as p, units_with_events, up, down,
  case when up + down > 0 then least(1.0::double, 2 * (select sum(factorial(cast(up + down as integer))::double
    / (factorial(cast(j as integer))::double * factorial(cast(up + down - j as integer))::double)) from range(0, least(up, down) + 1) t(j))
    * pow(0.5::double, up + down)) end as sign_p
from whole, f""",
    "recall_bound": f"with {SEGMENTS}, x as (select n_name, num, (1 - pow(0.025::double, 1 / den::double)) * den * 10 as most from nat) select n_name, most as max_missed, num / (num + most) as recall_lower from x",
    "detection_bootstrap": f"""with {SEGMENTS},
u as (select n_name, sum(num)::double as a, sum(den)::double as d, sum(case when c_mktsegment = 'BUILDING' then num else 0 end)::double as c
  from seg group by n_name),
{weighed("u", 300, "n_name")},
x as (select b, sum(w * a) / nullif(sum(w * d), 0) as share, sum(w * c) / nullif(sum(w * a), 0) as of_found from drawn group by b)
select 'share' as rate, count(share) as rounds, quantile_cont(share, 0.025) as low, quantile_cont(share, 0.975) as high from x
union all select 'of_found', count(of_found), quantile_cont(of_found, 0.025), quantile_cont(of_found, 0.975) from x""",
    "audit_sample": """with c as (select greatest(1, 300 // greatest(1, count(*))) as cell from (select distinct c_mktsegment, c_nationkey from customer)), r as (select c_custkey, c_mktsegment, c_nationkey, md5('audit|' || c_custkey) as h, row_number() over (partition by c_mktsegment, c_nationkey order by md5('audit|' || c_custkey), c_custkey) as pick from customer)
        select c_custkey, c_mktsegment, c_nationkey, cast(pick > cell as bigint) as extra from r, c order by extra, h, c_custkey limit 300""",
    "review_items": """with g as (select c_mktsegment, 83 // count(*) over () + cast(row_number() over (order by c_mktsegment) <= 83 % count(*) over () as bigint) as quota from (select distinct c_mktsegment from customer)),
        r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5('review|' || c_custkey), c_custkey) as pick from customer), i as (select c_custkey, c_mktsegment, row_number() over (order by md5('review|all|' || c_custkey), c_custkey) as k from r join g using (c_mktsegment) where pick <= quota)
        select 'it' || lpad(cast(k as varchar), 4, '0') as item_id, (k - 1) // 20 + 1 as batch, c_custkey, c_mktsegment from i""",
    "binary_precision_recall": f"""with {TRUTH}, v as (select case when truth in {tuple(outcomes.WRONG)} then 'ERROR' else 'OK' end as t, case when gate_label in {tuple(outcomes.WRONG)} then 'ERROR' else 'OK' end as f from t), l as (select distinct t as label from v union select distinct f from v),
        c as (select label, count(*) filter (t = label and f = label) as tp, count(*) filter (f = label) as n_found, count(*) filter (t = label) as n_true from l, v group by label) select *, tp / nullif(n_found, 0) as precision, tp / nullif(n_true, 0) as recall from c""",
    "within_budget": """select o_custkey, o_orderkey, spent_before from (select *, cast(coalesce(sum(cast(o_totalprice as decimal(18,4))) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as double) as spent_before from orders) where spent_before < 500000""",
    "estimated_cost": "with p as (select * from (values " + ", ".join(f"('{a}', {b}::double, {c}::double)" for a, b, c in PRICES) + """) p(lang, price_in, price_out)), d as (select lang, sum(length(coalesce(text, '')))::double / 3 * 2 as tokens_in, count(*) * 800.0::double as tokens_out from documents group by lang)
        select lang, tokens_in, tokens_out, tokens_in * price_in / 1e6::double + tokens_out * price_out / 1e6::double as cost from d join p using (lang)""",
    "usable_facts": "select event_id, k::bigint as k, case when k = 0 then user_id::double else round(value, 2) end as value from events, range(2) r(k) where event_id % 2 = 0 or event_id % 5 <> 1",
    "cache_misses": """with c as (select sha256(length(role) || ':' || role || length(coalesce(text, '')) || ':' || coalesce(text, '')) as key, conv_id, turn from conversations), a as (select key, max(1000 + conv_id % 3 * 500) as max_tokens from c group by key)
        select key, max_tokens from a where not exists (select 1 from c where c.key = a.key and turn % 2 = 0 and not (conv_id % 4 = 0 and a.max_tokens > 1200))""",
    "csv_heads": """with r as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as k, n_nationkey || ',' || case when n_nationkey % 2 = 0 then '"' || n_name || ', ""x""' || '"' else n_name end as row from nation)
        select n_regionkey, 'n_nationkey,name' || chr(10) || string_agg(row, chr(10) order by k) || chr(10) as csv from r where k <= 3 group by n_regionkey""",
    "prompts": "select n_nationkey, 'Week 2011-W42 of ' || n_name || ' (' || n_name || '), ' || n_regionkey || ' rows' as prompt from nation",
    "percent_texts": "with x as (select c_custkey, round_even(c_acctbal / 128 * 10, 0) / 10 as v from customer) select c_custkey, printf('%.1f', abs(v)) || '%' as plain, printf('%+.1f', v) || '%' as signed from x",
    "error_texts": "select o_orderkey, 'at ' || replace(replace(strftime(o_orderdate, '%Y-%m-%d'), '1996-0', '<month>'), '1996', '<year>') as text from orders",
    "note_texts": """select n_nationkey, '- ' || n_name || chr(10) || '- two' as bullets, 'print(' || n_nationkey || ')' || chr(10) as code, '12' || n_nationkey || '.50' as digits, n_nationkey % 10 between 6 and 8 as ok from nation""",
}

ORACLES["reply_store"] = """with r as (select cast(o_custkey as varchar) as key, case when o_orderstatus = 'O' then 'max_tokens' else 'end_turn' end as stop_reason, o_orderkey % 7 * 256 as max_tokens from orders)
select key, stop_reason, max_tokens from r qualify row_number() over (partition by key order by stop_reason, max_tokens desc) = 1"""
ORACLES["written_tables"] = f"""{WEEKLY},
{CHOSEN}, placed as (select week, entity, revenue, row_number() over (partition by week order by revenue desc, entity) as pos from weekly where revenue > 0)
select size || '_country_' || week as table_id, size, 'country' as entity_type, week, count(*) as n_rows, max(pos) as last_pos, cast(sum(cast(revenue as decimal(18,2))) as double) as revenue
from chosen join placed using (week) where pos <= n_rows group by size, week"""
ORACLES["resume_open_units"] = "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')"
