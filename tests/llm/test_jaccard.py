import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factledger.llm import jaccard, queries
from factledger.llm.common import possibly
from factledger.llm.components import components


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in where[g] if j < i}:
            n = len(s & sets[j])
            if s and 100 * n >= 80 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (7, 8), (5, 5), (12, 11), (11, 10), (10, 12), (20, 1)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 1, 7: 7, 8: 7, 10: 10, 11: 10, 12: 10}
    assert components(edges.limit(0)).collect() == []


def tree_pairs(n, bits):
    """The pairs that the trees of all widths leave."""
    out = set()
    for width, at, narrow in jaccard.widths(bits):
        tree = jaccard.SignatureTree(n[at], jaccard.signatures(bits, at, width), np.arange(len(at)), narrow)
        for a, b in tree.self_join():
            out |= {(min(p), max(p)) for p in zip(at[a].tolist(), at[b].tolist(), strict=True)}
    return out


@pytest.mark.parametrize("size", [5, 100, 700, 2000, 20000])
def test_tree_prunes_sets_of_any_size(size):
    """Unrelated sets of like size: nearly no pair is left to verify, however large the sets are."""
    rng = np.random.default_rng(size)
    bits = [jaccard.bitmap(rng.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(200)]
    assert len(tree_pairs(np.full(200, size), bits)) < 0.01 * 19_900


def test_repeated_rows_and_rows_without_id(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (1, text, "x"), (2, text, "x"), (None, text, "x"), (3, None, "x"), (3, None, "x"), (4, "own words here", "x")], "doc_id long, text string, source string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_per_component(docs).collect())
    assert kept == [(0, text), (1, text), (3, ""), (4, "own words here")]


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(1, 3000), dtype=np.uint64)
        for _ in range(3):
            x = base.copy()
            x[rng.random(len(x)) < rng.choice([0, 0.05, 0.12, 0.3])] += np.uint64(977)
            sets.append(np.unique(x))
    n = np.array([len(x) for x in sets])
    bits = [jaccard.bitmap(x) for x in sets]
    found = tree_pairs(n, bits)
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (n[i] + n[j] - common):
                assert (j, i) in found and jaccard.may_reach(bits[i], bits[j], int(n[i]), int(n[j]))
    assert len(found) < 60 * 59


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "TEXT_BLOCK", 3)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(30)]
    rows, doc = [], 0
    for _ in range(60):
        base = [word() for _ in range(rng.choice([1, 3, 5, 12, 40, 90]))] + (passage if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = [x if rng.random() > rng.choice([0, 0.01, 0.04]) else word() for x in base]
            rows.append((doc := doc + 1, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, rows[0][1]), (904, rows[0][1].upper()), (905, "x"), (906, "X")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute(rows)
    assert jaccard.jaccard_components(docs.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in jaccard.jaccard_components(twice).collect()] == [(1, 1), (1, 1)]
    kept = {r.doc_id for r in jaccard.one_per_component(docs).collect()}
    assert kept == {i for i, (n, c) in got.items() if c == i}


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_filter_passes_every_id(spark):
    ids = spark.range(0, 5000, 7).selectExpr("id - 900 as doc_id")
    passed = {r.id for r in spark.range(-900, 4100).where(possibly(ids, "doc_id")(F.col("id"))).collect()}
    own = {r.doc_id for r in ids.collect()}
    assert own <= passed and len(passed) < 1.05 * len(own)
    assert spark.range(9).where(possibly(ids.limit(0), "doc_id")(F.col("id"))).collect() == []


def test_links_of_clusters_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TEXT_BLOCK", 4)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    other = [f"v{k}" for k in range(60)]
    rows = []
    for i in range(25):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 1, 2, 4])):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(30 + i, rows[i][1]) for i in range(4)] + [(34, rows[0][1]), (40, " ".join(other)), (41, " ".join(other[:-3])), (50, "alone"), (51, None)]
    sets = sets_of(rows)
    near = {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame([*rows, rows[3], rows[-2]], "doc_id long, text string")
    got = jaccard.jaccard_components(docs).collect()
    assert {(r.doc_id, r.n_links) for r in got} == {(i, sum(i in p for p in near)) for i in sets}
    first = {r.doc_id: r.class_id for r in got}
    pairs = [tuple(r) for r in jaccard.jaccard_pairs(docs).collect()]
    assert sorted(pairs) == sorted(p for p in near if sets[p[0]] != sets[p[1]] and all(first[i] == i for i in p))
    assert len(pairs) > 2 * len({i for p in pairs for i in p})
