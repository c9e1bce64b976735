import hashlib

import pytest
from pyspark.sql import functions as F

from factledger.operators import cleaning, design, evaluation, outcomes
from factledger.sources import runs, scratch


def test_run_tables_and_settings(spark, tmp_path):
    df = spark.createDataFrame([("n", 1)], "note_id string, n int")
    runs.write_run(str(tmp_path / "run"), numbers=df, claims=df)
    assert [x.collect() for x in runs.read_run(spark, str(tmp_path / "run"), "numbers", "claims")] == [df.collect()] * 2
    runs.write_settings(spark, str(tmp_path / "set"), {"seed": 7, "models": ["a"]})
    assert runs.read_settings(spark, str(tmp_path / "set"), {"seed": 1, "n": 2}) == {"seed": 7, "models": ["a"], "n": 2}
    (tmp_path / "c.yaml").write_text("seed: 42  # fixed\nname: a plain text\nlist: [1, 2]\n\nempty:\n")
    assert runs.read_settings(spark, str(tmp_path / "c.yaml")) == {"seed": 42, "name": "a plain text", "list": [1, 2]}


def test_read_through_makes_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert runs.read_through(spark, str(tmp_path / "clean"), make).count() == 3
    assert made == [1]


def test_read_through_by_several_at_once(spark, tmp_path):
    """All find nothing and make a table; one is there in the end, whole, and all read it."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    path, wait = str(tmp_path / "table"), Barrier(3)

    def make(k):
        wait.wait()
        return spark.range(1000).select("id", F.lit(k).alias("who"))

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda k: runs.read_through(spark, path, lambda: make(k)).agg(F.count("id"), F.countDistinct("id"), F.countDistinct("who")).first(), range(3)))
    assert {tuple(r) for r in got} == {(1000, 1000, 1)}


def test_read_through_where_a_job_has_failed(spark, tmp_path):
    (tmp_path / "table").mkdir()
    assert runs.read_through(spark, str(tmp_path / "table"), lambda: spark.range(5)).count() == 5
    with pytest.raises(ZeroDivisionError):
        runs.read_through(spark, str(tmp_path / "other"), lambda: 1 / 0)
    assert runs.read_through(spark, str(tmp_path / "other"), lambda: spark.range(2)).count() == 2


def test_sheets_overlap(spark, tmp_path):
    for name, text in (("a", "invoice,n\n1,1\n2,1\n"), ("b", "invoice,n\n2,9\n3,9\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    got = runs.read_sheets(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")], "invoice string, n int", "invoice")
    assert sorted(map(tuple, got.collect())) == [("1", 1), ("2", 9), ("3", 9)]


def test_checked_json(spark, tmp_path):
    path = tmp_path / "truth.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    good = hashlib.sha256(path.read_bytes()).hexdigest()
    assert runs.read_checked_json(spark, str(path), "a int", good).count() == 2
    with pytest.raises(ValueError):
        runs.read_checked_json(spark, str(path), "a int", "0" * 64)


def test_scratch_goes(spark):
    df = scratch.stored(spark.range(5), "five")
    assert df.count() == 5
    scratch.discard(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.scratch_path).count()
    assert spark.createDataFrame([("x",)], "a string").select(runs.filled("{a}-{b}", {"a": F.col("a"), "b": F.lit(None)})).first()[0] == "x-"


def test_label_twice_is_an_error(spark):
    truth = spark.createDataFrame([(1, "Correct"), (2, "Correct")], "k int, truth string")
    for labels in ([(1, "a")], [(1, "a"), (2, "b"), (2, "c")]):
        with pytest.raises(Exception, match="not one label"):
            outcomes.with_gate_label(truth, spark.createDataFrame(labels, "k int, label string"), ["k"]).collect()


def test_replies_that_were_cut_off(spark):
    asked = spark.createDataFrame([("a", 100), ("a", 300), ("b", 300), ("c", 50), ("d", 10)], "key string, max_tokens long")
    had = spark.createDataFrame([("a", "max_tokens", 200), ("b", "end_turn", 10), ("c", "length", 50), (None, "end_turn", 5)], "key string, stop_reason string, max_tokens long")
    assert sorted(map(tuple, design.cache_misses(asked, had).collect())) == [("a", 300), ("d", 10)]


def test_facts_of_scripts(spark):
    rows = [(1, '[{"value": 1}, {"value": 2.5}, {"value": "3"}, {"value": true}, {"value": null}]'), (2, '{"facts": [{"value": 4}]}'), (3, "no list"), (4, None), (5, '[{"value": 1}] tail'), (6, "[" + ", ".join('{"value": %d}' % i for i in range(40)) + "]")]
    got = {}
    for r in design.usable_facts(spark.createDataFrame(rows, "k0 int, reply string"), "k0", "reply").orderBy("k0", "k").collect():
        got.setdefault(r.k0, []).append(r.value)
    assert got == {1: [1.0, 2.5], 2: [4.0], 6: [float(i) for i in range(25)]}


def test_cleaning_nulls(spark):
    rows = [("1", "12345", " a ", 1, 2.0, "UK"), (None, "12345", "a", 1, 2.0, "UK"), ("C1", "12345", "a", 1, 2.0, "UK"), ("1", "POST", "a", 1, 2.0, "UK"), ("1", "12345", "nan", 1, 2.0, "UK"), ("1", "12345", "a", 1, 2.0, None), ("1", "12345", "a", 0, 2.0, "UK")]
    df = spark.createDataFrame(rows, "invoice_no string, stock_code string, description string, quantity long, unit_price double, country string")
    assert [(r.description, float(r.revenue)) for r in cleaning.cleaned(df).collect()] == [("A", 2.0)]
    assert cleaning.rule_counts(df).first().asDict() == {"n": 7, "not_cancelled": 2, "positive": 1, "country_known": 1, "is_product": 1, "described": 1}


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id").repartition(7)
    got = [(r.k, r.at) for r in evaluation.numbered(rows, ["k"]).orderBy("k").collect()]
    assert got == [(k, k + 1) for k in range(1000)]
    tests = [(f"t{i:04}", ((i * 37) % 5000 + 1) / 1e7) for i in range(5000)]
    want, running = {}, 0.0
    for k, (name, p) in enumerate(sorted(tests, key=lambda x: (x[1], x[0]))):
        running = max(running, min(1.0, (5000 - k) * p))
        want[name] = running
    got = {r.name: r.p_holm for r in evaluation.holm(spark.createDataFrame(tests, "name string, p double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_nothing_to_draw_from(spark):
    none = spark.createDataFrame([], "k string, num long, den long")
    r = evaluation.bootstrap(none, "num", "den", "k", 20).first()
    assert (r.rounds, r.low) == (0, None)


NESTED = """# a remark
seed: 42   # fixed
writers:
  first-one:
    provider: mock
    price: 0.5
    on: true
  "other: one":
    provider: 'a # b'
    parts: [a, "b c", 3]
tables:
  - size: small
    rows: [5, 9]
    count: 4

  - size: large
    nested:
      deep: -1
names:
- x
- 2.5
nothing: ~
last: plain text: with a colon
"""


def test_nested_settings(spark, tmp_path):
    want = {
        "seed": 42, "writers": {"first-one": {"provider": "mock", "price": 0.5, "on": True}, "other: one": {"provider": "a # b", "parts": ["a", "b c", 3]}},
        "tables": [{"size": "small", "rows": [5, 9], "count": 4}, {"size": "large", "nested": {"deep": -1}}], "names": ["x", 2.5], "nothing": None, "last": "plain text: with a colon",
    }
    assert runs.settings_of(NESTED) == want
    assert runs.settings_of("") == {} == runs.settings_of("# only a remark")
    (tmp_path / "n.yaml").write_text(NESTED)
    got = runs.read_settings(spark, str(tmp_path / "n.yaml"), {"writers": {"first-one": {"limit": 7}, "third": 1}, "x": 0})
    assert got["x"] == 0 and got["writers"]["third"] == 1 and got["writers"]["first-one"] == {"limit": 7, "provider": "mock", "price": 0.5, "on": True}


def test_budget_of_one_long_run(spark):
    calls = [("one", i, ((i * 37) % 11) / 4) for i in range(3000)] + [("two", i, None if i % 3 else 5.0) for i in range(10)] + [(None, 1, 2.0), (None, 2, 9.0), (None, 3, 1.0)]
    df = spark.createDataFrame(calls, "run string, k int, cost double")
    got = {(r.run, r.k): r.spent_before for r in design.within_budget(df, "run", "k", "cost", 900.0).collect()}
    want, spent = {}, {}
    for run, k, cost in calls:
        if spent.get(run, 0) < 900:
            want[run, k] = spent.get(run, 0)
        spent[run] = spent.get(run, 0) + (cost or 0)
    assert got == want and 0 < len(got) < len(calls)
