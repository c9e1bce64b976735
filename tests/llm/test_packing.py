import zlib
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from factledger.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    plain = Tokenizer.from_file(PATH)
    want = []
    for doc, text in texts:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            cut = array("I", ids[k : k + 2048])
            want.append((doc, k // 2048, k, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r.length for r in rows) // 2048)


def test_chromosomes_stay_whole():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 500)
    a, b = packing.decreasing(lengths), packing.decreasing(lengths, rng)
    for _ in range(20):
        child = packing.mutated(lengths, packing.crossover(lengths, a, b, rng), rng)
        full = packing.fills(lengths, child)
        assert full.sum() == lengths.sum() and full.max() <= 2048 and full.min() > 0
        a, b = b, child
    plain = packing.decreasing(lengths)
    assert packing.fitness(lengths, packing.evolve(lengths, [], rng)) >= packing.fitness(lengths, plain)


def test_hidden_perfect_packing():
    rng = np.random.default_rng(1)
    cuts = [np.diff(np.sort(np.r_[0, rng.choice(np.arange(1, 2048), 4, replace=False), 2048])) for _ in range(120)]
    lengths = rng.permutation(np.concatenate(cuts))
    assert packing.evolve(lengths, [packing.evolve(lengths, [], rng)], rng).max() + 1 <= 122


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "same"), (4, "same"), (5, "a " * 2047), (6, "b " * 2048), *[(10 + i, "x y z " * (7 * i)) for i in range(40)]]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, length int, shard int")
    used, least = check(packing.pack(docs, PATH).collect(), texts)
    assert used <= least + 3
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check(queries.op8_best_fit_packing(spark, sf_dir).collect(), texts)
    assert used <= 1.02 * least + 1


def islands(lengths):
    """What a shard goes through: islands, whose elites migrate."""
    rng = lambda island, epoch: np.random.default_rng([7, island, epoch])
    now = [packing.evolve(lengths, [], rng(0, 0))] * packing.ISLANDS
    for epoch in range(1, packing.EPOCHS + 1):
        now = [packing.evolve(lengths, [now[i], now[i - 1]], rng(i, epoch)) for i in range(packing.ISLANDS)]
    return max(now, key=lambda x: packing.fitness(lengths, x))


def test_better_than_best_fit_on_hard_lengths():
    rng = np.random.default_rng(3)
    for low, high in ((300, 900), (500, 800)):
        lengths = rng.integers(low, high + 1, 2000)
        best = islands(lengths)
        assert packing.fills(lengths, best).max() <= packing.CAPACITY
        assert best.max() + 1 <= 0.98 * (packing.decreasing(lengths).max() + 1)


def test_fill_is_the_largest_sum():
    rng = np.random.default_rng(4)
    for _ in range(200):
        sizes = rng.integers(1, 40, rng.integers(0, 9)).tolist()
        room = int(rng.integers(0, 120))
        got = packing.filled(sizes, room)
        sums = {0}
        for x in sizes:
            sums |= {y + x for y in sums if y + x <= room}
        assert len(set(got)) == len(got) and sum(sizes[k] for k in got) == max(sums)
