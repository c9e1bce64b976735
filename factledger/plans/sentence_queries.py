"""Sentences of many shapes made from orders, and what a reader must find in each number of theirs.

A shape is a list of texts and numbers. What a number must be read as is stated with the shape; its text, value and place
follow from the order's columns, in Spark for the sentence and in DuckDB for the reading that it must get."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.operators.mentions import mentions, note_lines
from factledger.sources.tables import table

# name: text in Spark, text in DuckDB, decimals, scale
NUMBERS = {
    "money": ("concat('£', format_number(cast(o_totalprice as double), 2))", "'£' || format('{:,.2f}', cast(o_totalprice as double))", 2, 1),
    "thousands": ("concat('$', o_orderkey % 900 + 1, 'k')", "'$' || (o_orderkey % 900 + 1) || 'k'", 0, 1000),
    "share": ("concat(format_string('%.1f', (o_orderkey % 997 + 1) / 10), '%')", "printf('%.1f', (o_orderkey % 997 + 1) / 10) || '%'", 1, 1),
    "loss": ("concat('-', format_string('%.1f', (o_custkey % 499 + 1) / 10), '%')", "'-' || printf('%.1f', (o_custkey % 499 + 1) / 10) || '%'", 1, 1),
    "few": ("cast(o_orderkey % 90 + 3 as string)", "cast(o_orderkey % 90 + 3 as varchar)", 0, 1),
    "more": ("cast(o_custkey % 90 + 3 as string)", "cast(o_custkey % 90 + 3 as varchar)", 0, 1),
    "place": ("concat(o_orderkey % 90 + 4, 'th')", "(o_orderkey % 90 + 4) || 'th'", 0, 1),
    "ratio": ("concat(o_custkey % 90 + 3, 'x')", "(o_custkey % 90 + 3) || 'x'", 0, 1),
    "week": ("cast(o_orderkey % 52 + 1 as string)", "cast(o_orderkey % 52 + 1 as varchar)", 0, 1),
    "year": ("cast(1990 + o_orderkey % 45 as string)", "cast(1990 + o_orderkey % 45 as varchar)", 0, 1),
}


@dataclass(frozen=True)
class Number:
    """A number of a sentence and the reading that it must get."""

    name: str
    unit: str = "plain"
    direction: str = "none"
    sign: int = 0
    rank: bool = False
    hedge: str = "none"
    hint: str = ""
    skip: str = ""


SHAPES: list[list[str | Number]] = [
    ["Revenue was about ", Number("money", "currency", hedge="approx", hint="tw"), " TW."],
    ["Sales fell ", Number("share", "percent", "down", -1), " on LW"],
    ["Orders grew more than ", Number("share", "percent", "up", 1, hedge="over", hint="ly"), " LY"],
    ["It ranked #", Number("few", "count", rank=True)],
    ["It came ", Number("place", "count", rank=True), " in the table"],
    ["Ranks ", Number("few", "count", rank=True), " to ", Number("more", "count", rank=True), " hold"],
    ["The top ", Number("few", skip="counting"), " markets in week ", Number("week", skip="date_or_week"), " of ", Number("year", skip="year")],
    ["", Number("few", skip="counting"), " of the ", Number("more", skip="counting"), " countries grew"],
    ["Up ", Number("money", "currency", "up", 1), ". Then c.", Number("thousands", "currency", hedge="approx"), " came"],
    ["Gave up ", Number("money", "currency", "down", -1, hint="lw"), " LW, less than ", Number("share", "percent", hedge="under")],
    ["Volume was ", Number("ratio", hint="lw"), " LW"],
    ["A change of ", Number("loss", "percent", sign=-1), " by then"],
    ["Sold ", Number("more", "count"), " units, some "],
    ["It stood No.", Number("few", "count", rank=True), "; Income of nearly ", Number("money", "currency", hedge="approx"), " came"],
]


def sentence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of a sentence about each order."""
    text = F.lit(None).cast("string")
    for k, shape in enumerate(SHAPES):
        said = F.concat(*[F.expr(NUMBERS[x.name][0]) if isinstance(x, Number) else F.lit(x) for x in shape])
        text = F.when(F.col("o_orderkey") % len(SHAPES) == k, said).otherwise(text)
    lines = note_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("note_id"), F.lit("").alias("table_id"), text.alias("note")))
    return mentions(lines).select(
        F.col("note_id").cast("long").alias("o_orderkey"), "mention_idx", "raw_text", "value", F.col("decimals").cast("int").alias("decimals"), "scale", "unit", "signed", "direction", "is_rank", "is_ratio", "qualifier", "period_hint", "position", "skip_reason",
    )


def sentences_sql() -> str:
    parts = []
    for k, shape in enumerate(SHAPES):
        before, at = [], 0
        for x in shape:
            if isinstance(x, str):
                before.append(f"'{x}'")
                continue
            _, said, decimals, scale = NUMBERS[x.name]
            size = f"cast(regexp_replace({said}, '[^0-9.]', '', 'g') as double)"
            parts.append(f"""select o_orderkey, {at} as mention_idx, {said} as raw_text, {size} * {-1 if x.sign < 0 else 1} * {scale}.0::double as value, {decimals} as decimals, {scale}.0::double as scale,
  '{x.unit}' as unit, {x.sign != 0} as signed, '{x.direction}' as direction, {x.rank} as is_rank, {x.name == "ratio"} as is_ratio, '{x.hedge}' as qualifier, '{x.hint}' as period_hint,
  length({" || ".join(before)}) as position, '{x.skip}' as skip_reason from orders where o_orderkey % {len(SHAPES)} = {k}""")
            before.append(said)
            at += 1
    return " union all\n".join(parts)


QUERIES = {"sentence_numbers": sentence_numbers}
ORACLES = {"sentence_numbers": sentences_sql()}
