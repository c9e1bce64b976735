"""Texts of a megabyte and more beside short ones: every operator takes them whole."""

import random

import pytest

import public_tokenizers
from factledger.llm import decontaminate, fingerprint, jaccard, langid, packing, quality, repeats, secrets, tokenfile, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = [f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(200_000)]
    tail = "the quick brown fox jumps over the lazy dog near the old river bank today token=abcdefghijklmnop"
    long = " ".join(words) + " " + tail
    rows = [(1, long, "en", "s", len(long)), (2, tail, "en", "s", len(tail)), (3, long, "en", "s", len(long)), (4, None, "en", "s", 0), (5, "", "de", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache(), long, tail


def test_every_operator(spark, docs):
    df, long, tail = docs
    assert {r.doc_id for r in repeats.repeated_passages(df).collect()} == {3}
    assert {r.doc_id: r.lang_pred for r in langid.identify(df, langid.fit(df)).collect()}[1] == "en"
    found = {r.doc_id: r.spans for r in secrets.find_secrets(df).collect()}
    assert [(s.start, s.end) for s in found[1]] == [(len(long) - 22, len(long))]
    bench = spark.createDataFrame([(7, tail.rsplit(" ", 1)[0])], "item_id long, text string")
    got = {(r.doc_id, r.distance): (r.start, r.end) for r in decontaminate.contamination(df, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0)} and long[slice(*got[1, 0])] == tail.rsplit(" ", 1)[0]
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_components(df).collect()} == {1: (1, 1), 2: (2, 0), 3: (1, 1), 4: (4, 0), 5: (5, 0)}
    marks = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(df, fingerprint.lexicon(df)).collect()}
    assert marks[1] == marks[3] != marks[2]
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.score(df, quality.fit(df, labels)).count() == 5
    assert toxicity.severity(df, toxicity.fit(df, labels)).count() == 5


def test_tokens(spark, docs):
    df, _, _ = docs
    pieces = packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 1").orderBy("piece").collect()
    assert [p.length for p in pieces[:-1]] == [2048] * (len(pieces) - 1) and [p.start for p in pieces] == [2048 * k for k in range(len(pieces))]
    target = tokenfile.new_target(spark)
    tokenfile.write(df, target, public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in tokenfile.read(spark, target).collect()}
    assert rows[1].ids == rows[3].ids and rows[3].start == rows[1].n_tokens + rows[2].n_tokens
