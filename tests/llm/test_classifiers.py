import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from factledger.llm import quality, queries, toxicity
from factledger.llm.common import Words


def test_ordinal_gradient_leads_to_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    truth = np.array([2.0, -1.0, 0.0])
    z = x @ truth + rng.logistic(size=3000)
    grades = np.searchsorted([-1.0, 0.5, 2.0], z)
    rows, cols = np.repeat(np.arange(3000), 3), np.tile(np.arange(3), 3000)
    weights, thresholds = toxicity.ordinal_fit(rows, cols, x.ravel(), grades, 3)
    assert np.allclose(weights, truth, atol=0.25) and np.allclose(thresholds, [-1.0, 0.5, 2.0], atol=0.25)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.severity(docs, model).withColumnRenamed("toxic", "found").join(labels.where(held), "doc_id").collect()
    clean = [r.found for r in rows if not r.toxic]
    bad = [r for r in rows if r.toxic]
    assert sum(clean) <= 0.02 * len(clean)
    assert np.mean([r.expected_severity for r in bad]) > 5 * np.mean([r.expected_severity for r in rows if not r.toxic])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you vile fool " * 3, 1), (2, "kind words", 2), (3, None, 3), (4, "", 4), (None, "fool", 5)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.severity(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.expected_severity <= 3 for r in rows)
    for some in (labels.limit(0), labels.where("toxic = 0")):
        rows = toxicity.severity(docs, toxicity.fit(docs, some)).collect()
        assert len({r.expected_severity for r in rows}) == 1 and not any(r.toxic for r in rows)
    assert toxicity.severity(docs.limit(0), toxicity.fit(docs.limit(0), labels)).collect() == []


def test_co_training_learns_from_the_other_view(spark):
    """Each view tells the class with one feature of 50 in 85 % of the rows; 60 of 2,000 rows have labels."""
    gains = []
    for seed in range(1, 4):
        rng = np.random.default_rng(seed)
        n = 2000
        y = rng.integers(0, 2, n)
        pick = lambda: np.where(rng.random(n) < 0.85, y, 1 - y) * 50 + rng.integers(0, 50, n)  # noqa: B023, E731
        docs = spark.createDataFrame([(i, f"w{a}", f"s{b}", "x", 7) for i, (a, b) in enumerate(zip(pick().tolist(), pick().tolist()))], "doc_id long, text string, source string, lang string, n_chars long").cache()
        labels = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "doc_id long, quality int")
        right = []
        for rounds in (quality.ROUNDS, 0):
            got = quality.score(docs, quality.fit(docs, labels, rounds=rounds)).collect()
            right.append(np.mean([r.keep == bool(y[r.doc_id]) for r in got if r.doc_id >= 60]))
        gains.append(right[0] - right[1])
        docs.unpersist()
    assert min(gains) > 0 and np.mean(gains) > 0.03, gains


def plain_fit(rows, y, steps, rate, ridge):
    """Logistic regression with dictionaries, one row after the other."""
    names = sorted({c for r in rows for c, _ in r})
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    w, bias = dict.fromkeys(names, 0.0), np.log(share / (1 - share))
    m, v = dict.fromkeys([*names, None], 0.0), dict.fromkeys([*names, None], 0.0)
    for step in range(1, steps + 1):
        grad = {c: ridge * w[c] for c in names} | {None: 0.0}
        for r, t in zip(rows, y):
            e = (1 / (1 + np.exp(-(sum(w[c] * x for c, x in r) + bias))) - t) / len(rows)
            grad[None] += e
            for c, x in r:
                grad[c] += e * x
        for c, g in grad.items():
            m[c], v[c] = 0.9 * m[c] + 0.1 * g, 0.999 * v[c] + 0.001 * g * g
            move = rate * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-8)
            if c is None:
                bias -= move
            else:
                w[c] -= move
    return w, bias


def test_logistic_equals_the_plain_form():
    rng = np.random.default_rng(3)
    rows = [sorted({int(c): float(rng.random()) for c in rng.integers(0, 40, rng.integers(1, 6))}.items()) for _ in range(50)]
    y = rng.integers(0, 2, 50).tolist()
    x = (np.repeat(np.arange(50), [len(r) for r in rows]), np.array([c for r in rows for c, _ in r]), np.array([v for r in rows for _, v in r]))
    got = quality.logistic(x, np.array(y, float))
    w, bias = plain_fit(rows, y, quality.STEPS, quality.RATE, quality.RIDGE)
    assert abs(got.bias - bias) < 1e-6 and all(abs(got.weights[c] - v) < 1e-6 for c, v in w.items())


def test_few_labels_follow_the_same_rule(spark):
    docs = spark.createDataFrame([(i, f"{'good' if i % 2 else 'bad'} word{i}", "s", "en", 9) for i in range(40)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    p = {r.doc_id: r.p_text for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(set(p.values())) > 1


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(1, "vile fool", "s", "en", 9)] * 50 + [(2, "kind", "s", "en", 4), (3, "kind soul", "s", "en", 9)], "doc_id long, text string, source string, lang string, n_chars long")
    one = docs.dropDuplicates(["doc_id"])
    tox = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    a, b = (toxicity.fit(x, tox) for x in (docs, one))
    assert a.decision == b.decision and np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_severity_against_a_plain_form(spark):
    """Scores of a fitted model, term by term."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.terms.tolist(), model.weights.tolist()))
    for r in docs.join(toxicity.severity(docs, model), "doc_id").collect():
        low = "".join(c.lower() if c.isascii() else c for c in r.text or "")
        terms = Counter(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", low))
        score = sum(weight.get(int(Words([w]).hash[0]), 0.0) * np.log1p(n) for w, n in terms.items())
        above = [1 / (1 + np.exp(-(score - t))) for t in model.thresholds]
        assert abs(r.expected_severity - sum(above)) < 1e-6 and abs(r.p_toxic - above[0]) < 1e-6
        grades = -np.diff([1.0, *above, 0.0])
        assert r.grade == int(np.argmax(grades)) and r.toxic == (r.p_toxic >= model.decision)


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    rows = quality.score(docs, quality.fit(docs, labels.where(~held))).withColumnRenamed("quality", "p").join(labels.where(held), "doc_id").collect()
    good = [r.keep for r in rows if r.quality]
    bad = [r.keep for r in rows if not r.quality]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 5, 1), (2, None, None, None, None, 2), (3, "", "s", "en", -1, 3), (None, "| | |", "t", "de", 10**12, 4)], "doc_id long, text string, source string, lang string, n_chars long, keep int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = quality.score(docs, quality.fit(docs, some)).collect()
        assert len(rows) == 4 and all(0 <= r.quality <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


def test_queries_score_every_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.op3_quality_classifier(spark, sf_dir).count() == n
    assert queries.op10_toxicity(spark, sf_dir).count() == n
