"""The roll-up of sales against the clean lines, on tables with repeated and missing keys, and what its plan shuffles."""

import os

from pyspark.sql import functions as F

from factledger.operators import reports


def odd_tables(spark, sf_dir, out):
    """Tables of which some orders, parts and customers are there twice, some not at all, and some parts have no name."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    twice = lambda df, key, n: df.where(F.col(key) % n > 0).unionByName(df.where(F.col(key) % n == 1))
    blank = F.when(F.col("p_partkey") % 7 == 0, "  ").when(F.col("p_partkey") % 9 == 0, None).otherwise(F.col("p_name"))
    odd = {
        "lineitem": read("lineitem"), "nation": read("nation"), "orders": twice(read("orders"), "o_orderkey", 5).unionByName(read("orders").where("o_orderkey % 11 = 1").withColumn("o_orderdate", F.col("o_orderdate") + F.expr("interval 9 days"))),
        "part": twice(read("part"), "p_partkey", 6).withColumn("p_name", blank), "customer": twice(read("customer"), "c_custkey", 8),
    }
    for name, df in odd.items():
        df.write.parquet(f"{out}/{name}.parquet")
    return str(out)


def test_roll_up_equals_that_of_the_clean_lines(spark, sf_dir, tmp_path):
    for where in (sf_dir, odd_tables(spark, sf_dir, tmp_path)):
        for entity in ("country", "product", "brand"):
            want = reports.weekly_rollup(reports.clean_lines(spark, where), entity)
            got = reports.weekly_sales(spark, where, entity)
            assert got.schema.simpleString() == want.schema.simpleString()
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_reads_the_lines_once(spark, sf_dir):
    """Counting invoices shuffles no line again, and the report reads a stored roll-up, not the lines four times."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        country = plan(reports.weekly_sales(spark, sf_dir, "country"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Both sides by part, by customer and by order, and the sums by week: none for each order's week and entity.
    assert "Expand" not in country and country.count("Exchange hashpartitioning") == 7
    assert "l_orderkey" not in plan(reports.report_tables(reports.weekly_sales(spark, sf_dir, "country"), 10))


def test_lines_meet_parts_without_a_shuffle_where_their_keys_are_dense(spark, sf_dir):
    """A part table too large to be broadcast has its keys in a 64th of the rows, which can be."""
    size = os.path.getsize(f"{sf_dir}/part.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size // 2))
    try:
        country = plan(reports.weekly_sales(spark, sf_dir, "country"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(l_partkey" not in country and country.count("hashpartitioning(l_orderkey") == 1


def test_revenues_of_any_size_and_precision_are_summed_exactly(spark, sf_dir, tmp_path):
    """Large prices, fractions of a cent, halves that are rounded, odd discounts, nulls, and keys beyond 64 and below 0."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = F.col("l_orderkey")
    price = F.when(n % 9 == 0, 1e15).when(n % 9 == 1, F.lit(1.005)).when(n % 9 == 2, F.lit(-3.5)).when(n % 9 == 3, F.lit(None)).when(n % 9 == 4, F.lit(123456789012.34)).when(n % 9 == 5, F.lit(0.004)).otherwise(F.col("l_extendedprice"))
    discount = F.when(n % 5 == 0, 0.125).when(n % 5 == 1, -0.5).when(n % 5 == 2, 1.0).when(n % 5 == 3, F.lit(0.07)).otherwise(F.col("l_discount"))
    away = lambda c: F.when(F.col(c) % 3 == 0, -F.col(c)).when(F.col(c) % 3 == 1, F.col(c) + (1 << 40)).otherwise(F.col(c))
    lines = read("lineitem").withColumns({"l_extendedprice": price, "l_discount": discount, "l_partkey": away("l_partkey")})
    tables = {"lineitem": lines, "part": read("part").withColumn("p_partkey", away("p_partkey")), **{x: read(x) for x in ("orders", "customer", "nation")}}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    for entity in ("country", "product"):
        want = sorted(map(tuple, reports.weekly_rollup(reports.clean_lines(spark, str(tmp_path)), entity).collect()))
        assert sorted(map(tuple, reports.weekly_sales(spark, str(tmp_path), entity).collect())) == want and len(want) > 100
