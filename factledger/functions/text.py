"""Small text functions on notes and tables, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.functions import lexicons as lx


def bullets(note: Column) -> Column:
    """The lines of a note that are bullets (-, * or a dot), each with one dash."""
    lines = F.transform(F.split(note, r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: x.rlike(r"^[-*•]\s*\S"))
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), F.regexp_replace(x, r"^[-*•]\s*", ""))), "\n")


def well_formed(note: Column) -> Column:
    """Six to eight lines, all bullets, each with a digit, and no em dash."""
    lines = F.filter(F.split(note, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.size(lines).between(6, 8) & F.forall(lines, lambda x: F.trim(x).rlike("^-") & x.rlike("[0-9]")) & ~F.contains(note, F.lit("—"))


def fenced_code(text: Column) -> Column:
    """What the first fenced block holds; the whole text without one."""
    return F.when(text.rlike("(?s)```(?:python)?\\s*\n(.*?)```"), F.regexp_extract(text, "(?s)```(?:python)?\\s*\n(.*?)```", 1)).otherwise(text)


def number_text(text: Column) -> Column:
    """Digits and points alone."""
    return F.regexp_replace(text, "[^0-9.]", "")


def money(value: Column) -> Column:
    """Compact pounds: millions with two decimals, thousands with one, else pence."""
    return (
        F.when(value.isNull(), "n/a").when(F.abs(value) >= 1e6, F.format_string("£%.2fM", value / 1e6)).when(F.abs(value) >= 1e4, F.format_string("£%.1fk", value / 1e3))
        .otherwise(F.concat(F.lit("£"), F.format_number(value, 2)))
    )


def percent(value: Column, signed: bool = False) -> Column:
    """One decimal and a percent mark; the magnitude alone unless ``signed``. Halves go to the even digit, as for the
    rounded columns of a report."""
    one = F.rint(value * 10) / 10
    return F.format_string("%+.1f%%" if signed else "%.1f%%", one if signed else F.abs(one))


def without_paths(text: Column, places: dict[str, str]) -> Column:
    """The text with each path replaced by its placeholder, longer paths first, so that it is the same on every machine."""
    for path, placeholder in sorted(places.items(), key=lambda x: (-len(x[0]), x[0])):
        text = F.replace(text, F.lit(path), F.lit(placeholder))
    return text


def csv_head(rows: DataFrame, table: str, order: list[str], columns: list[str], n: int = 3) -> DataFrame:
    """The head and the first ``n`` rows of each table as CSV text; a value with a comma, quote or line break is quoted."""
    top = rows.withColumn("pos", F.row_number().over(Window.partitionBy(table).orderBy(*order))).where(F.col("pos") <= n)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: F.when(plain(c).rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(plain(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain(c))
    body = top.groupBy(table).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(",", *[cell(c) for c in columns]).alias("row")))).alias("x"))
    return body.select(table, F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.col("x.row"), "\n"), F.lit("\n")).alias("csv"))


def cache_key(*parts: Column) -> Column:
    """Key of a request by its content: SHA-256 of its parts, each with its length, so that parts can't run together."""
    return F.sha2(F.concat(*[F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def markdown(rows: DataFrame, table: str, order: list[str], columns: list[str]) -> DataFrame:
    """One Markdown table for each value of ``table``; a table is bounded by the rows that a report shows."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = rows.groupBy(table).agg(F.sort_array(F.collect_list(F.struct(*order, row.alias("row")))).alias("x"))
    return body.select(table, F.concat(F.lit(head), F.array_join(F.col("x.row"), "\n")).alias("markdown"))


def from_markdown(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of the Markdown table in each text as ``key``, ``pos`` and an array of cells, its head as position 0."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^\|[-|: ]+\|?$"))
    return texts.select(key, F.posexplode(lines).alias("pos", "line")).select(key, "pos", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))


def trailing_direction(line: Column, end: Column) -> Column:
    """Whether a direction and what it compares with follow a number that ends at ``end``, as in "£5, down from £9"."""
    return line.substr(end + 1, F.lit(25)).rlike(lx.TRAILING_DIRECTION)
