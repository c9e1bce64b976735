from math import comb

from pyspark.sql import functions as F

from factledger.operators import claims, evaluation


def cdf(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def test_exact_interval(spark):
    cases = [(0, 10), (10, 10), (3, 10), (1, 451), (97, 317), (0, 1)]
    df = spark.createDataFrame(cases, "k int, n int")
    low, high = evaluation.clopper_pearson(F.col("k"), F.col("n"))
    for r in df.select("k", "n", low.alias("low"), high.alias("high"), evaluation.binomial_cdf(F.col("k"), F.col("n"), F.lit(0.3)).alias("cdf")).collect():
        assert abs(r.cdf - cdf(r.k, r.n, 0.3)) < 1e-9
        assert r.low == 0 if r.k == 0 else abs(1 - cdf(r.k - 1, r.n, r.low) - 0.025) < 1e-6
        assert r.high == 1 if r.k == r.n else abs(cdf(r.k, r.n, r.high) - 0.025) < 1e-6


def test_replies(spark):
    rows = [("a", "t", 'Here: {"claims": [{"line": 0, "entity": "UK", "metric": "revenue", "period": "WoW", "value_text": "15.9%", "direction": "down"}, {"line": 1, "value_text": 4}]} done'), ("b", "t", "no claims"), ("c", "t", '{"claims": []}'), ("d", "t", None)]
    df = spark.createDataFrame(rows, "note_id string, table_id string, reply string")
    got = claims.claims_of_replies(df).orderBy("claim_idx").collect()
    assert [(r.note_id, r.line_idx, r.entity, r.value_text, r.direction) for r in got] == [("a", 0, "UK", "15.9%", "down"), ("a", 1, "", "4", "none")]
    assert sorted(r.note_id for r in claims.unread_replies(df).collect()) == ["b", "d"]
