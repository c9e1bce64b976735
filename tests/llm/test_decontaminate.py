import random
import re

import numpy as np
import pytest
from pyspark.sql import Row

from factledger.llm import decontaminate, queries
from factledger.llm.common import mix


def plain(item, text):
    """Least edits that make the item a stretch of the text: the full table, row by row."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def test_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        d, a, b = decontaminate.nearest(item, text)
        assert d == plain(item, text)
        row = list(range(b - a + 1))
        for i, w in enumerate(item, 1):
            row = _next(row, i, w, text[a:b])
        assert row[-1] == d


def _next(row, i, w, text):
    new = [i]
    for j, t in enumerate(text, 1):
        new.append(min(row[j - 1] + (w != t), row[j] + 1, new[-1] + 1))
    return new


def edited(rng, item, word, edits):
    w = list(item)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [word()], [word(), w[k]]])
        w = w or [word()]
    return w


def planted(seed, items, docs, low, high):
    """Items, and documents that each hold one of them with up to 28 % edits, of words that follow Zipf's law."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    word = lambda: rng.choices(vocabulary, weight)[0]
    bench = [[word() for _ in range(rng.randint(low, high))] for _ in range(items)]
    texts = []
    for _ in range(docs):
        item = rng.choice(bench)
        text = [word() for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(text))
        text[at:at] = edited(rng, item, word, rng.randint(0, int(0.28 * len(item))))
        texts.append(text)
    return bench, texts


@pytest.mark.parametrize("low,high", [(1, 7), (8, 60), (80, 320)])
def test_recall_and_no_false_reports(spark, low, high):
    """Against plain edit distance of every item over every text: nothing is shared with the operator."""
    bench, texts = planted(low, 40, 100, low, high)
    items = spark.createDataFrame([Row(item_id=i, text=" ".join(w)) for i, w in enumerate(bench)])
    docs = spark.createDataFrame([Row(doc_id=i, text=" ".join(w)) for i, w in enumerate(texts)])
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contamination(docs, items).collect()}
    want = {(d, i): x for d, t in enumerate(texts) for i, w in enumerate(bench) if (x := plain(w, t)) <= len(w) // 5}
    assert got.items() <= want.items() and len(want) > 50
    assert len(got) >= 0.98 * len(want), (len(got), len(want))


def test_filter_changes_no_row(spark):
    """Windows laid everywhere give what windows laid where the q-gram lemma allows them give."""
    bench, texts = planted(9, 30, 60, 3, 40)
    items = spark.createDataFrame([Row(item_id=i, text=" ".join(w)) for i, w in enumerate(bench)])
    docs = spark.createDataFrame([Row(doc_id=i, text=" ".join(w)) for i, w in enumerate(texts)])
    with_, without = ({tuple(r) for r in decontaminate.contamination(docs, items, filtered=f).collect()} for f in (True, False))
    assert with_ and with_ == without


def test_lsh_turns_unrelated_windows_away():
    """Windows that share a word in eight with an item, at its place, are candidates in a few cases only."""
    rng = np.random.default_rng(5)
    n, vocabulary = 40, mix(np.arange(1, 5000).astype(np.uint64))
    passed = 0
    for _ in range(50):
        item, other = vocabulary[rng.integers(0, 4999, n)], vocabulary[rng.integers(0, 4999, (40, n))]
        other[:, 3::8] = item[3::8]
        own = decontaminate.keys(item[None, :])[1]
        row, value = decontaminate.keys(other)
        passed += len(set(row[np.isin(value, own)].tolist()))
    assert passed < 0.1 * 2000, passed


def test_long_intervals_are_cut(spark):
    bench, _ = planted(3, 1, 0, 12, 12)
    text = " ".join((bench[0] + ["zz"]) * 1000)
    items = spark.createDataFrame([Row(item_id=0, text=" ".join(bench[0]))])
    docs = spark.createDataFrame([Row(doc_id=0, text=text)])
    r = decontaminate.contamination(docs, items).collect()
    assert [(x.doc_id, x.item_id, x.distance, x.start) for x in r] == [(0, 0, 0, 0)]


def test_edges(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0), (2, None, 0), (3, "", 0), (4, "...", 0), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0), (None, "alpha", 0)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([(10, "É x. ALPHA, beta gamma delta epsilon zeta eta theta iota  kappa!%% y", 5), (11, "alpha beta gamma delta epsilon zeta eta theta", 5), (12, "alpha beta gamma delta epsilon zeta eta", 5), (13, None, 5), (14, "", 5), (10, "É x. ALPHA, beta gamma delta epsilon zeta eta theta iota  kappa!%% y", 5), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 5)], "doc_id long, text string, item_id int")
    rows = decontaminate.contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == [(10, 1, 0), (11, 1, 2)]
    r = next(r for r in rows if r.doc_id == 10)
    assert "É x. ALPHA, beta gamma delta epsilon zeta eta theta iota  kappa!%% y"[r.start : r.end] == "ALPHA, beta gamma delta epsilon zeta eta theta iota  kappa"
    assert decontaminate.contamination(docs, bench.limit(0)).collect() == []
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    kept = decontaminate.without_contaminated(docs, bench)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 12, 13, 14]


def test_query_against_brute_force(spark, sf_dir):
    """Every item against every text over all places."""
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op5_decontamination(spark, sf_dir).collect()}
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {}
    for item_id, item in [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]:
        own = {w: k for k, w in enumerate(item)}
        item_at = np.array([own[w] for w in item])
        for doc_id, text in docs:
            row = np.zeros(len(text) + 1, np.int64)
            at = np.array([own.get(w, -1) for w in text], np.int64)
            place = np.arange(len(text) + 1)
            for i, w in enumerate(item_at, 1):
                new = np.empty_like(row)
                new[0] = i
                new[1:] = np.minimum(row[:-1] + (at != w), row[1:] + 1)
                row = np.minimum.accumulate(new - place) + place
            if row.min() <= len(item) // 5:
                want[doc_id, item_id] = int(row.min())
    assert want and got == want
