import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factledger.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % 10000


def plain(docs, target):
    """The contract's words, one feature at a time."""
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in docs:
        for f in runs(text)[1]:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text)[1]:
            t[bucket(f)] += 1
    S, T = int(s.sum()), int(t.sum())
    gain = [math.floor(1000 * math.log((int(b) + 1) * (S + 10000) / ((int(a) + 1) * (T + 10000)))) for a, b in zip(s, t)]
    rows = []
    for doc, text in docs:
        words, found = runs(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, docs, target, parts=3):
    d = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, score long, part string").repartition(parts)
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in resample.resample(d, t).collect()), key=str)


@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=8))
@settings(max_examples=100, deadline=None)
def test_prefixes_give_every_runs_crc(parts):
    whole = b"".join(parts)
    ends = np.cumsum([0, *map(len, parts)])
    prefix = np.array([zlib.crc32(whole[:e]) for e in ends], np.uint32)
    for i in range(len(parts)):
        for j in range(i, len(parts)):
            by = np.array([ends[j + 1] - ends[i]])
            assert int((prefix[j + 1 : j + 2] ^ resample.shifted(prefix[i : i + 1], by))[0]) == zlib.crc32(whole[ends[i] : ends[j + 1]])


@given(st.lists(st.text(alphabet=st.sampled_from("aZ09 \n\t./@[`{~\x00\x7fñЖ漢😀"), max_size=60), max_size=5))
@settings(max_examples=200, deadline=None)
def test_features(texts):
    count, doc, found = resample.features(texts)
    for i, text in enumerate(texts):
        words, want = runs(text)
        assert count[i] == len(words)
        assert sorted(found[doc == i].tolist()) == sorted(map(bucket, want))


def test_long_words_and_runs():
    texts = ["x" * 70_000 + " b " + "y" * 5_000_000 + " c", "a"]
    _, doc, found = resample.features(texts)
    assert sorted(found[doc == 0].tolist()) == sorted(bucket(f) for f in runs(texts[0])[1])


def test_brute_force(spark):
    words = "alpha beta Gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    docs = [(i, " ".join(words[(i * j + j * j) % 14] for j in range(5 + i % 40))) for i in range(400)]
    docs += [(7, docs[7][1]), (7, docs[39][1]), (None, docs[39][1]), (None, None), (1001, None), (1002, ""), (1003, " ./ "), (1004, "one,two")]
    docs += [(2000 + i, docs[39][1]) for i in range(300)]  # copies of one text
    target = ["zeta eta theta iota", "alpha; beta", None, ""]
    assert run(spark, docs, target) == plain(docs, target)


def test_empty_tables(spark):
    docs = [(1, "a b c " * 30)] * 25
    assert run(spark, docs, []) == plain(docs, [])
    assert run(spark, [], ["a b"]) == []


def test_sum_of_twenty(spark):
    docs = [(i, f"w{i % 7} " * (19 + i % 3)) for i in range(60)]  # 40 of them are long enough: two are drawn
    got = run(spark, docs, ["w1 w1 w1"])
    assert got == plain(docs, ["w1 w1 w1"]) and sorted(r[4] for r in got if r[4]) == [1, 2]
