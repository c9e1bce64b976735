import pytest

import corpus_pipeline
from factledger.llm import secrets
from factledger.llm.common import stored

from tests.llm.test_decontaminate import plain, words
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
        assert df.count() == df.select("doc_id").distinct().count()


def test_language_keeps_what_has_one(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert all(not any(c.isalpha() for c in before[i].text) or len(before[i].text) < 200 for i in before.keys() - after.keys())
    assert len(after) >= 0.97 * len(before)
    assert sum(after[i].lang == before[i].lang for i in after) >= 0.97 * len(after)
    assert all(after[i].text == before[i].text for i in after)


def test_near_duplicates_leave_one(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = brute([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, (_, c) in groups.items() if c == i}


def test_decontamination_drops_what_holds_an_item(spark, sf_dir, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = before.keys() - after.keys()
    assert gone
    for i in gone:
        assert any(plain(x, words(before[i].text)) <= len(x) // 5 for x in items)
    for i in after:
        text = " ".join(words(after[i].text))
        assert not any(" ".join(x) in text for x in items)


def test_secrets_are_replaced(stages):
    before, after = rows(stages[3]), rows(stages[4])
    automaton = secrets.automaton()
    assert before.keys() == after.keys()
    for i, r in before.items():
        assert after[i].text == secrets.redact(r.text, secrets.scan(r.text, automaton)) and after[i].n_chars == len(after[i].text)
        assert after[i].lang == r.lang and after[i].source == r.source


def test_packing_and_run(spark, sf_dir, stages):
    texts = [(r.doc_id, r.text) for r in stages[4].collect()]
    used, least = check(stages[5].collect(), texts)
    assert used <= 1.02 * least + 1
    again = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def test_empty_tables_and_nulls(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None, 1), (3, None, "en", "s", 0, 1), (4, "", None, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.drop("extra").limit(0), sf_dir).collect() == []
        stage(spark, docs, sf_dir).collect()


def test_columns_that_clash(spark, sf_dir):
    """Columns of documents that have a result's name, or marks in theirs, go through every stage that keeps columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    more = docs.selectExpr("*", "doc_id as score", "doc_id as lang_pred", "'s' as spans", "1 as `a.b`", "2 as Lang_Spans", "3 as id", "4 as component_id", "5 as class_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf_dir)
        assert out.columns == more.columns and out.count() > 0
        assert all(r.score == r.doc_id and r.spans == "s" for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, more, sf_dir).count() >= 60


def test_exact_copies_under_one_id_go(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words that stand twice here", "en", "s", 9), (1, "some words that stand twice here", "en", "s", 9), (None, "some words that stand twice here", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1]
