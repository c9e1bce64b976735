"""Samples stay bounded whatever the ids: none, one for all rows, or rows that repeat."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from factledger.llm import langid, quality, tokenfile
from factledger.llm.common import SLOTS, drawn

PATH = public_tokenizers.path("byte_bpe_50k.json")
KINDS = ["half without id", "one id", "one row", "ids"]


def docs_of(spark, kind, n=20_000):
    text = F.lit("the same text in every row") if kind == "one row" else F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" of many words"))
    doc = {"half without id": F.when(F.col("id") % 2 == 0, F.col("id")), "one id": F.lit(7).cast("long"), "one row": F.lit(7).cast("long"), "ids": F.col("id")}[kind]
    return spark.range(n).select(doc.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(20).cast("long").alias("n_chars"), F.lit(1).alias("mark"))


@pytest.mark.parametrize("kind", KINDS)
def test_share_of_distinct_rows(spark, kind):
    n = drawn(docs_of(spark, kind), F.lit(SLOTS // 20), ["doc_id", "text"]).count()
    assert n <= 1 if kind == "one row" else 800 <= n <= 1200


@pytest.mark.parametrize("kind", KINDS)
def test_dictionary_sample(spark, monkeypatch, kind):
    monkeypatch.setattr(tokenfile, "SAMPLE", 500)
    docs = docs_of(spark, kind)
    got = tokenfile.sampled_ids(docs, 20_000, PATH, "byte")
    assert len(got) <= 1 if kind == "one row" else 350 <= len(got) <= 650


def test_dictionary_sample_of_long_texts(spark):
    docs = spark.createDataFrame([(1, "word and " * 6_000_000), (None, "x" * 100_000)], "doc_id long, text string")
    got = tokenfile.sampled_ids(docs, 2, PATH, "byte")
    assert len(got) == 2 and all(len(x) <= tokenfile.PIECE for x in got)


@pytest.mark.parametrize("kind", KINDS)
def test_language_sample(spark, monkeypatch, kind):
    monkeypatch.setattr(langid, "MAX_TRAIN", 300)
    seen = []
    monkeypatch.setattr(langid, "drawn", lambda *a: seen.append(drawn(*a)) or seen[-1])
    assert langid.fit(docs_of(spark, kind)).languages == ["en"]
    n = seen[0].count()
    assert n <= 1 if kind == "one row" else 180 <= n <= 420


@pytest.mark.parametrize("kind", KINDS)
def test_pseudo_labels(spark, monkeypatch, kind):
    seen = []
    gathered = quality._gathered
    monkeypatch.setattr(quality, "_gathered", lambda rows: seen.append(gathered(rows)) or seen[-1])
    docs = docs_of(spark, kind, 6000).unionByName(spark.createDataFrame([(10_000 + i, f"{'good clean prose' if i % 2 else 'spam buy now !!!'} {i}", "en", "s", 20, 1) for i in range(200)], "doc_id long, text string, lang string, source string, n_chars long, mark int"))
    labels = spark.createDataFrame([(10_000 + i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels, pseudo=300, rounds=1)
    assert len(seen[0]) == 200 and all(len(x) <= 420 for x in seen[1:])
    assert quality.score(docs, model).count() == docs.count()
