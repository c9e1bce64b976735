"""Rules that raw sales lines must pass, as a list of named conditions; columns are named by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = {"invoice": "invoice_no", "stock": "stock_code", "description": "description", "quantity": "quantity", "price": "unit_price", "country": "country"}


def description(x: Column) -> Column:
    return F.upper(F.trim(x.cast("string")))


def rules(columns: dict[str, str] = COLUMNS) -> dict[str, Column]:
    """Each rule's condition; null counts as failed. Cancelled invoices begin with C, products have codes of five digits."""
    c = {k: F.col(v) for k, v in columns.items()}
    return {
        "not_cancelled": ~c["invoice"].cast("string").startswith("C"), "positive": (c["quantity"] > 0) & (c["price"] > 0), "country_known": c["country"] != "Unspecified", "is_product": c["stock"].cast("string").rlike("^[0-9]{5}"),
        "described": ~description(c["description"]).isin("NAN", ""),
    }


def cleaned(lines: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """The lines that pass all rules, with ``revenue`` and the description trimmed and in capitals."""
    for ok in rules(columns).values():
        lines = lines.where(F.coalesce(ok, F.lit(False)))
    revenue = (F.col(columns["quantity"]) * F.col(columns["price"]).cast("decimal(18,4)")).cast("decimal(24,4)")
    return lines.withColumn(columns["description"], description(F.col(columns["description"]))).withColumn("revenue", revenue)


def rule_counts(lines: DataFrame, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """How many lines fail each rule, and all lines, in one pass."""
    return lines.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules(columns).items()])
