"""Period-comparison report tables from order lines: clean, week, roll up, compare, rank.

Sums are exact decimals that become doubles once, so they don't hang on the order of rows; ties are broken by name."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.sources.scratch import stored
from factledger.sources.tables import table

REVENUE = "l_extendedprice", "l_discount"
HIGH = 10**12


def _revenue() -> Column:
    price, discount = map(F.col, REVENUE)
    return (price.cast("decimal(18,2)") * (F.lit(1) - discount.cast("decimal(4,2)"))).cast("decimal(24,4)")


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line with its invoice, day, country, product, quantity and revenue. Dimensions are small and Spark
    broadcasts them where their size allows it."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    where = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    joined = item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(where, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("invoice_no"), "day", F.col("n_name").alias("country"), F.upper(F.trim("p_name")).alias("product"), F.col("p_brand").alias("brand"),
        F.col("l_quantity").cast("long").alias("quantity"), _revenue().alias("revenue"), F.col("l_returnflag").alias("flag"),
    )


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without returned lines, non-positive quantities and revenues, and lines without country or product."""
    return sales_lines(spark, sf_dir).where("flag <> 'R' and quantity > 0 and revenue > 0 and country is not null and product <> ''")


def week_label(day: Column) -> Column:
    """'YYYY-Www' of the ISO week."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))


def with_weeks(lines: DataFrame) -> DataFrame:
    return lines.withColumn("week_start", F.date_trunc("week", "day").cast("date")).withColumn("week", week_label(F.col("day")))


def _cents(x: str, most: int) -> tuple[Column, Column]:
    """A double in hundredths as a whole number, and whether it is that many hundredths exactly, and no more than ``most``."""
    c = F.rint(F.col(x).cast("double") * 100)
    return c.cast("long"), F.coalesce((F.abs(c) <= most) & (c / 100 == F.col(x).cast("double")), F.lit(False))


def _priced(item: DataFrame) -> DataFrame:
    """The lines with their revenue in ten-thousandths as two longs, ``units`` and ``high``, which counts ``HIGH`` of them: sums of longs
    cost a fraction of those of decimals. Where price and discount are whole hundredths and no more than usual the product of longs is exact;
    others go by decimals."""
    (price, plain), (discount, low) = _cents(REVENUE[0], 10**8), _cents(REVENUE[1], 100)
    item = item.withColumns({"fast": plain & low, "exact": F.when(~(plain & low), (_revenue() * 10000).cast("decimal(28,0)"))})
    high = F.when(F.col("fast"), 0).otherwise(F.expr(f"exact div {HIGH}"))
    return item.withColumns({"units": F.when(F.col("fast"), price * (100 - discount)).otherwise((F.col("exact") % HIGH).cast("long")), "high": high.cast("long")})


def _held_keys(part: DataFrame) -> DataFrame:
    """Which keys are there, 64 of them a row: ``block``, ``keys`` (a bit for each key), and ``level`` 1; those of a key that is there n
    times in n levels. It is stored, so that Spark knows how small it is."""
    n = part.where("p_partkey is not null").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n")).select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("level"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(p_partkey & 63 as int))"))
    return stored(n.groupBy(F.expr("shiftright(p_partkey, 6)").alias("block"), "level").agg(bits.alias("keys")), "keys")


def weekly_sales(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """``weekly_rollup`` of the clean lines by ``country``, ``product`` or ``brand``, with one shuffle of the lines where the parts can be
    broadcast. Lines meet orders last, so that both lie by order; there each order gives one row for each of its weeks and
    entities, and counting those rows counts invoices without another shuffle. By country, lines are summed by order before
    they meet anything but parts, of which they need no more than which there are, a bit each. An order line that meets several
    parts, or an order that is there twice, counts as often as in ``clean_lines``."""
    item = _priced(table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"), *REVENUE)).where("quantity > 0 and (units > 0 or high > 0)").drop(*REVENUE, "fast", "exact")
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("product"), F.col("p_brand").alias("brand")).where("product <> ''")
    sums = [F.sum(x).alias(x) for x in ("units", "high", "quantity")]
    if entity == "country":
        held = item.join(_held_keys(part), F.expr("shiftright(l_partkey, 6) = block")).where("getbit(keys, cast(l_partkey & 63 as int)) = 1")
        sold = held.groupBy("l_orderkey").agg(*sums)
    else:
        sold = item.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", entity, "quantity", "units", "high")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.trunc(F.to_date("o_orderdate"), "week").alias("week_start"))
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country")).where("country is not null")
    placed = order.join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "week_start", "c_nationkey")
    met = sold.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    each = met.groupBy("l_orderkey", "week_start", F.col(entity).alias("entity")).agg(*sums)
    summed = lambda x, unit: (F.sum(F.col(x).cast("decimal(20,0)")) * F.lit(Decimal(unit))).cast("decimal(38,4)")
    revenue = summed("units", "0.0001") + summed("high", str(HIGH // 10**4))
    out = each.groupBy("week_start", "entity").agg(revenue.cast("double").alias("revenue"), F.sum("quantity").alias("units"), F.count(F.lit(1)).alias("orders"))
    return out.select(week_label(F.col("week_start")).alias("week"), "week_start", "entity", "revenue", "units", "orders")


def weekly_rollup(lines: DataFrame, entity: str) -> DataFrame:
    """Revenue, units and distinct invoices of each week and entity."""
    return with_weeks(lines).groupBy("week", "week_start", F.col(entity).alias("entity")).agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("quantity").alias("units"), F.countDistinct("invoice_no").alias("orders")
    )


def eligible_weeks(lines: DataFrame, days: int = 4) -> DataFrame:
    """Weeks with enough trading days, whose week before has enough too."""
    good = with_weeks(lines).groupBy("week", "week_start").agg(F.countDistinct("day").alias("n_days")).where(F.col("n_days") >= days)
    before = good.select(F.date_add("week_start", 7).alias("week_start"))
    return good.join(before, "week_start", "left_semi").select("week", "week_start", "n_days")


def percent_change(new: Column, old: Column) -> Column:
    """Rounded half-even at one decimal of the scaled double; null where the base is missing or not above zero."""
    return F.when(old > 0, F.rint((new - old) / old * 100 * 10) / 10)


def cents(x: Column) -> Column:
    return F.rint(x * 100) / 100


def report_tables(weekly: DataFrame, top: int) -> DataFrame:
    """The report of every week: the top entities by revenue, beside last week and the same ISO week of last year.

    An entity that did not trade in a week of the data has 0 there; a week outside the data is null. Share and rank are
    within the rows shown. Window functions rank within a week, so nothing is collected. The roll-up is read four times, so it
    is stored once made."""
    weekly = stored(weekly, "weekly")
    ranked = weekly.where("revenue > 0").withColumn("pos", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("revenue"), "entity"))).where(F.col("pos") <= top)
    last_year = F.concat((F.substring("week", 1, 4).cast("int") - 1).cast("string"), F.substring("week", 5, 4))
    now = ranked.select("week", "week_start", "entity", "pos", cents(F.col("revenue")).alias("revenue_tw"), F.col("units").alias("units_tw"), F.col("orders").alias("orders_tw"), last_year.alias("ly_week"))
    before = weekly.select(F.date_add("week_start", 7).alias("week_start"), "entity", cents(F.col("revenue")).alias("lw_revenue"), F.col("units").alias("lw_units"), F.col("orders").alias("lw_orders"))
    year = weekly.select(F.col("week").alias("ly_week"), "entity", cents(F.col("revenue")).alias("ly_revenue"))
    known = weekly.select(F.col("week").alias("ly_week")).distinct().withColumn("known", F.lit(True))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    joined = now.join(before, ["week_start", "entity"], "left").join(year, ["ly_week", "entity"], "left").join(known, "ly_week", "left")
    out = joined.select(
        "week", "entity", "pos", "revenue_tw", zero("lw_revenue").cast("double").alias("revenue_lw"), F.when(F.col("known"), zero("ly_revenue").cast("double")).alias("revenue_ly"),
        "units_tw", zero("lw_units").alias("units_lw"), "orders_tw", zero("lw_orders").alias("orders_lw"),
    )
    return with_derived(out)


def with_derived(rows: DataFrame, table_id: str = "week") -> DataFrame:
    """The derived columns, from the stored rounded ones, so that they recompute exactly."""
    total = F.sum(F.col("revenue_tw").cast("decimal(18,2)")).over(Window.partitionBy(table_id)).cast("double")
    return rows.select(
        "*",
        percent_change(F.col("revenue_tw"), F.col("revenue_lw")).alias("wow_pct"),
        percent_change(F.col("revenue_tw"), F.col("revenue_ly")).alias("yoy_pct"),
        (F.rint(F.col("revenue_tw") / total * 100 * 10) / 10).alias("share_pct"),
        F.rank().over(Window.partitionBy(table_id).orderBy(F.desc("revenue_tw"))).cast("long").alias("rank"),
    )


def not_recomputing(report: DataFrame, table_id: str = "week") -> DataFrame:
    """Rows whose stored derived columns differ from those that their level columns give."""
    derived = ["wow_pct", "yoy_pct", "share_pct", "rank"]
    stored = report.withColumnsRenamed({c: f"stored_{c}" for c in derived})
    again = with_derived(stored, table_id)
    same = [F.col(f"stored_{c}").eqNullSafe(F.col(c)) | (F.abs(F.col(f"stored_{c}") - F.col(c)) < 1e-6) for c in derived]
    return again.where(~(same[0] & same[1] & same[2] & same[3]))


def without_overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of both, where a key that both have counts from the second."""
    return first.join(second.select(key).distinct(), key, "left_anti").unionByName(second)


def facts(report: DataFrame, top: int = 3) -> DataFrame:
    """For each week the first rows by revenue, the greatest rises and falls against last week, and the row with most orders:
    ``fact``, ``n``, ``entity``, ``value``. Ties go by name. All ranks share one shuffle by week."""
    wanted = {"top": ("revenue_tw", F.desc, F.lit(True), top), "up": ("wow_pct", F.desc_nulls_last, F.col("wow_pct") > 0, top), "down": ("wow_pct", F.asc_nulls_last, F.col("wow_pct") < 0, top), "most_orders": ("orders_tw", F.desc, F.lit(True), 1)}
    ranked = report.select("*", *[F.row_number().over(Window.partitionBy("week").orderBy(order(c), "entity")).alias(f"n_{k}") for k, (c, order, _, _) in wanted.items()])
    each = [F.when(keep & (F.col(f"n_{k}") <= n), F.struct(F.lit(k).alias("fact"), F.col(f"n_{k}").cast("long").alias("n"), F.col(c).cast("double").alias("value"))) for k, (c, _, keep, n) in wanted.items()]
    return ranked.select("week", "entity", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("f")).select("week", "f.fact", "f.n", "entity", "f.value")
