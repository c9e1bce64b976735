from factledger.sources import files

REPORT = "week string, entity string, pos int, revenue_tw double, wow_pct double"


def test_reports_come_back(spark, tmp_path):
    rows = [("2010-W27", "United Kingdom", 1, 89759.37, -15.9), ("2010-W27", 'A "B", C', 2, 0.5, None), ("2010-W47", "Japan", 1, 5735.24, 12485.6)]
    files.write_reports(spark.createDataFrame(rows, REPORT), f"{tmp_path}/r")
    got = files.read_csv(spark, f"{tmp_path}/r", REPORT).select("week", "entity", "pos", "revenue_tw", "wow_pct").orderBy("week", "pos").collect()
    assert [tuple(r) for r in got] == rows
    files.write_reports(spark.createDataFrame(rows[2:], REPORT), f"{tmp_path}/r")
    assert files.read_csv(spark, f"{tmp_path}/r", REPORT).count() == 1
    assert files.read_csv(spark, f"{tmp_path}/none", REPORT).count() == 0


def test_notes_come_back(spark, tmp_path):
    schema = "note_id string, table_id string, note string"
    files.write_notes(spark.createDataFrame([("a", "t", "- one 1\n- two"), ("b", "t", None)], schema), f"{tmp_path}/n")
    (tmp_path / "n" / "broken.json").write_text('{"note_id": "c", \n')
    got = files.read_notes(spark, f"{tmp_path}/n", schema).orderBy("note_id").collect()
    assert [(r.note_id, r.note) for r in got] == [("a", "- one 1\n- two"), ("b", None)] and all(r.file for r in got)


def test_one_file_a_table_and_an_index(spark, tmp_path):
    rows = [("b t", "small", 1, "x, y"), ("b t", "small", 2, None), ("a", "large", 1, "z"), (None, "large", 1, "lost")]
    df = spark.createDataFrame(rows, "table_id string, size string, pos int, entity string")
    for expected in (df, df.where("table_id = 'a'")):
        files.write_tables(expected, str(tmp_path), ["size"])
        kept = expected.where("table_id is not null")
        got = files.read_tables(spark, str(tmp_path), "pos int, entity string")
        assert sorted(map(str, got.select("table_id", "pos", "entity").collect())) == sorted(map(str, kept.select("table_id", "pos", "entity").collect()))
    files.write_tables(df, str(tmp_path), ["size"])
    assert all(len(list(folder.glob("*.csv"))) == 1 for folder in (tmp_path / "tables").iterdir() if folder.is_dir())
    index = files.read_csv(spark, f"{tmp_path}/index", "table_id string, size string, n_rows long").collect()
    assert [tuple(r) for r in index] == [("a", "large", 1), ("b t", "small", 2)]
    plan = files.read_tables(spark, str(tmp_path), "pos int, entity string").where("table_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_id" in plan
    assert files.table_index(df.limit(0), ["size"]).count() == 0
