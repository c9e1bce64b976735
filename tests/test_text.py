from pyspark.sql import functions as F

from factledger.functions import text


def test_text_functions(spark):
    ok = "\n".join(f"- line {i}" for i in range(6))
    df = spark.createDataFrame([(f"Title\n* one 1\n-two 2\n\n• three", "pre ```python\nx = 1\n``` post", 1234567.0), (ok, "plain", 12345.0), (ok + " —", "", None), ("", "a", 999.5)], "note string, code string, v double")
    rows = df.select(text.bullets(F.col("note")).alias("b"), text.well_formed(F.col("note")).alias("w"), text.fenced_code(F.col("code")).alias("c"), text.money(F.col("v")).alias("m"), text.number_text(F.lit("£1,234.5k")).alias("n")).collect()
    assert rows[0].b == "- one 1\n- two 2\n- three" and [r.w for r in rows] == [False, True, False, False]
    assert rows[0].c == "x = 1\n" and rows[1].c == "plain"
    assert [r.m for r in rows] == ["£1.23M", "£12.3k", "n/a", "£999.50"] and rows[0].n == "1234.5"
