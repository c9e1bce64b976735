import random
import zlib
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factledger.llm import ffd, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, texts, least_cut=ffd.LEAST_CUT):
    """Every id lies in exactly one piece, pieces follow each other in their sequences; padding and cuts."""
    plain = Tokenizer.from_file(PATH)
    left = {}
    for doc, text in texts:
        left.setdefault(doc, []).append(array("I", [*plain.encode(text or "", add_special_tokens=False).ids, 0]))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(left)
    for doc, ids in left.items():
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids[0]))
                assert r.ids_crc32 == zlib.crc32(ids[0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(ids[0])
        else:
            assert sum(r.length for r in pieces[doc]) == sum(map(len, ids))
    waste = 0
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        assert ffd.padding(at) < least_cut
        waste += ffd.padding(at)
    least = sum(-(-len(i) // 1024) for x in left.values() for i in x)
    return waste, len(rows) - least


def plain_first_fit(lengths, capacity):
    rooms, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((k for k, room in enumerate(rooms) if room >= lengths[i]), None)
        if b is None:
            b = len(rooms)
            rooms.append(capacity)
            bins.append([])
        rooms[b] -= lengths[i]
        bins[b].append(i)
    return bins


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tree_is_first_fit_decreasing(lengths):
    assert ffd.first_fit_decreasing(lengths, 50) == plain_first_fit(lengths, 50)


@given(st.lists(st.integers(1, 64), max_size=60), st.integers(1, 12))
@settings(max_examples=300, deadline=None)
def test_gaps_are_closed(lengths, least_cut):
    bins = ffd.first_fit_decreasing(lengths, 64)
    out = ffd.close_gaps(lengths, bins, 64, least_cut)
    ids = sorted((p, at + k) for s in out for p, at, n in s for k in range(n))
    assert ids == [(p, k) for p, n in enumerate(lengths) for k in range(n)]
    sizes = [sum(n for _, _, n in s) for s in out]
    assert all(0 < x <= 64 for x in sizes)
    assert all(ffd.padding(x, 64) < max(1, least_cut) for x in sizes)


def test_large_group_is_full():
    rng = random.Random(5)
    lengths = [rng.randint(1, 1023) for _ in range(4000)]
    out = ffd.close_gaps(lengths, ffd.first_fit_decreasing(lengths), least_cut=1)
    assert sum(ffd.padding(sum(n for _, _, n in s)) for s in out) == 0
    assert len(out) <= sum(lengths) // 1024 + 10


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(ffd, "GROUP", 16)
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "same"), (4, "same"), (5, "a " * 1023), (6, "b " * 1024), (None, "no id here"), *[(10 + i, "x y z " * (7 * i)) for i in range(60)]]
    docs = spark.createDataFrame([(*t, 1, 2, 3) for t in texts], "doc_id long, text string, length int, group int, ids int").repartition(3)
    cuts = None
    for least_cut in (1, 8, 64):
        waste, fewer = check(ffd.pack(docs, PATH, least_cut=least_cut).collect(), texts, least_cut)
        assert (waste == 0 or least_cut > 1) and (cuts is None or fewer <= cuts)
        cuts = fewer
    assert ffd.pack(docs.limit(0), PATH).collect() == []


def test_one_long_text_and_many_copies(spark):
    texts = [(1, "river bank " * 60_000), *[(2 + i, "the same short text") for i in range(3000)]]
    rows = ffd.pack(spark.createDataFrame(texts, "doc_id long, text string"), PATH).collect()
    waste, cuts = check(rows, texts)
    assert waste <= 100 and cuts <= 40


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = queries.op11_first_fit_packing(spark, sf_dir)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = df.collect()
    waste, cuts = check(rows, texts)
    assert waste <= 0.005 * sum(r.length for r in rows) and cuts <= 0.2 * len(texts)  # one group of 200 documents leaves more gaps than a full one
