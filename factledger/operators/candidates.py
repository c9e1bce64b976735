"""Values that a note may cite: cells of a report table and fixed derived values, as rows (table_id, value, unit, evidence).

Input rows have ``week`` as the table's id. Everything is a projection, an aggregation by table or a join within it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The unit of every numeric column of a report table.
COLUMN_UNIT = {
    "revenue_tw": "currency", "revenue_lw": "currency", "revenue_ly": "currency", "units_tw": "count", "units_lw": "count", "orders_tw": "count", "orders_lw": "count",
    "wow_pct": "percent", "yoy_pct": "percent", "share_pct": "percent", "rank": "rank",
}
MEASURES = {"revenue": "currency", "units": "count", "orders": "count"}
LEVELS = [c for c, unit in COLUMN_UNIT.items() if unit in ("currency", "count")]


def cells(report: DataFrame) -> DataFrame:
    """One row for each cell that isn't null."""
    doubles = report.select("week", "entity", *[F.col(c).cast("double").alias(c) for c in COLUMN_UNIT])
    long = doubles.unpivot(["week", "entity"], list(COLUMN_UNIT), "col", "value").where("value is not null")
    unit = F.create_map(*[F.lit(x) for pair in COLUMN_UNIT.items() for x in pair])[F.col("col")]
    return long.select("week", "entity", "col", "value", unit.alias("unit"))


def column_aggregates(report: DataFrame) -> DataFrame:
    """Sum, mean, median, greatest and least of the level columns, the last three and the mean of percent columns."""
    long = cells(report).where("unit <> 'rank'")
    exact = F.sum(F.col("value").cast("decimal(18,2)"))
    agg = long.groupBy("week", "col", "unit").agg(
        exact.cast("double").alias("sum"), (exact.cast("double") / F.count("value")).alias("mean"), F.median("value").alias("median"), F.max("value").alias("max"), F.min("value").alias("min")
    )
    kinds = agg.unpivot(["week", "col", "unit"], ["sum", "mean", "median", "max", "min"], "op", "value")
    return kinds.where("unit <> 'percent' or op in ('mean', 'max', 'min')").select("week", F.concat("op", F.lit("("), "col", F.lit(")")).alias("evidence"), "value", "unit")


def totals(report: DataFrame) -> DataFrame:
    """One row a table with the sum of each level column and the number of rows."""
    sums = [F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(c) for c in LEVELS]
    return report.groupBy("week").agg(*sums, F.count(F.lit(1)).alias("n_rows"))


def period_totals(report: DataFrame) -> DataFrame:
    """Difference, change, percentage and ratio of this period's totals to last week's and last year's."""
    t = totals(report)
    rows = []
    for m, p in [("revenue", "lw"), ("units", "lw"), ("orders", "lw"), ("revenue", "ly")]:
        a, b = F.col(f"{m}_tw"), F.expr(f"nullif({m}_{p}, 0)")
        for op, value, unit in [("diff", F.col(f"{m}_tw") - F.col(f"{m}_{p}"), MEASURES[m]), ("pct_change", (a - b) / b * 100, "percent"), ("pct_of", a / b * 100, "percent"), ("ratio", a / b, "ratio")]:
            rows.append(F.struct(F.lit(f"{op}(sum {m}_tw, sum {m}_{p})").alias("evidence"), value.alias("value"), F.lit(unit).alias("unit")))
    return t.select("week", F.explode(F.array(*rows)).alias("x")).select("week", "x.*").where("value is not null")


def topk_cumulative(report: DataFrame, most: int = 10) -> DataFrame:
    """Revenue and share of the first k rows, and of the rows after them."""
    order = Window.partitionBy("week").orderBy(F.desc("revenue_tw"), "entity")
    money = F.col("revenue_tw").cast("decimal(18,2)")
    running = report.select(
        "week", F.row_number().over(order).alias("k"), F.sum(money).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("top"), F.sum(money).over(Window.partitionBy("week")).alias("total")
    ).where(F.col("k") <= most)
    top, rest, total = (F.col(x).cast("double") for x in ("top", "rest", "total"))
    return running.withColumn("rest", F.col("total") - F.col("top")).select("week", F.col("k").cast("int").alias("k"), top.alias("sum_topk"), (top / total * 100).alias("share_topk"), rest.alias("sum_after"), (rest / total * 100).alias("share_after"))


def per_order_unit(report: DataFrame) -> DataFrame:
    """Revenue an order, revenue a unit and units an order of the totals of two periods, and their change."""
    t = totals(report)
    ratio = lambda a, b: F.col(a) / F.expr(f"nullif({b}, 0)")
    out = t.select("week", *[ratio(f"{a}_{p}", f"{b}_{p}").alias(f"{n}_{p}") for n, a, b in [("per_order", "revenue", "orders"), ("per_unit", "revenue", "units"), ("units_per_order", "units", "orders")] for p in ("tw", "lw")])
    return out.select("*", *[((F.col(f"{n}_tw") - F.col(f"{n}_lw")) / F.expr(f"nullif({n}_lw, 0)") * 100).alias(f"{n}_change") for n in ("per_order", "per_unit", "units_per_order")])


def entity_changes(report: DataFrame) -> DataFrame:
    """Difference, change, percentage and ratio of each entity's measures between periods."""
    rows = []
    for m, p in [("revenue", "lw"), ("units", "lw"), ("orders", "lw"), ("revenue", "ly")]:
        a, b = F.col(f"{m}_tw").cast("double"), F.expr(f"nullif(cast({m}_{p} as double), 0)")
        for op, value in [("diff", a - F.col(f"{m}_{p}").cast("double")), ("pct_change", (a - b) / b * 100), ("pct_of", a / b * 100), ("ratio", a / b)]:
            rows.append(F.struct(F.lit(f"{op}({m}_{p})").alias("evidence"), value.alias("value")))
    return report.select("week", "entity", F.explode(F.array(*rows)).alias("x")).select("week", "entity", "x.*").where("value is not null")


def entity_shares(report: DataFrame) -> DataFrame:
    """Each entity's share of the column totals, its share's change in points, its ratio to the mean, and the total
    without it."""
    t = totals(report).select("week", "n_rows", *[F.col(c).alias(f"t_{c}") for c in LEVELS])
    j = report.join(t, "week")
    share = lambda c: F.col(c).cast("double") / F.expr(f"nullif(t_{c}, 0)") * 100
    return j.select(
        "week", "entity", *[share(c).alias(f"share_{c}") for c in ("revenue_tw", "revenue_lw", "units_tw", "units_lw", "orders_tw", "orders_lw")],
        (share("revenue_tw") - share("revenue_lw")).alias("share_change_pp"), (F.col("revenue_tw") / (F.col("t_revenue_tw") / F.col("n_rows"))).alias("ratio_to_mean"),
        (F.col("t_revenue_tw") - F.col("revenue_tw")).alias("sum_excluding"),
    )


def pairwise(report: DataFrame) -> DataFrame:
    """Difference, change and ratio of this period's revenue of each ordered pair of the entities of a table."""
    a = report.select("week", F.col("entity").alias("a"), F.col("revenue_tw").alias("x"))
    b = report.select("week", F.col("entity").alias("b"), F.col("revenue_tw").alias("y"))
    return a.join(b, "week").where("a <> b").select("week", "a", "b", (F.col("x") - F.col("y")).alias("diff"), ((F.col("x") - F.col("y")) / F.col("y") * 100).alias("pct_change"), (F.col("x") / F.col("y")).alias("ratio"))


def _gram(n: int):
    """The n words from the i-th on. A function of its own: Spark binds a lambda's every argument to a column."""
    return lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")


def families(report: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """Entities of a table that share a word run of one to three words: an equi-join on the run instead of a search for it
    in every name. ``fragment``, ``members``, and their revenue and share."""
    words = F.expr("regexp_extract_all(lower(entity), '([a-z]+)', 1)")
    grams = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), _gram(n)) for n in (1, 2, 3)]))
    rows = report.select("week", "entity", "revenue_tw", words.alias("w")).where("size(w) > 0").select("week", "entity", "revenue_tw", F.explode(F.array_distinct(grams)).alias("fragment"))
    total = totals(report).select("week", F.col("revenue_tw").alias("total"))
    out = rows.groupBy("week", "fragment").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("revenue_tw").cast("decimal(18,2)")).cast("double").alias("revenue")).where(f"members between {least} and {most}")
    return out.join(total, "week").select("week", "fragment", "members", "revenue", (F.col("revenue") / F.col("total") * 100).alias("share"))
