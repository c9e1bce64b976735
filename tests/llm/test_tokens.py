import zlib
from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factledger.llm import queries, tokenfile
from factledger.llm.encode import encoder

FILES = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}
PIECES = [" ", "  ", "\n", "\n", "A.\nB", "\t", "\r\n", "The", "straße", "Élan", "don't", "'s", "1234", "a1b2", "***", "%%%.", "|", "日本", "é", "é", "́", "\x85", " ", "\x1c", "İ", "ª", "×", "<|endoftext|>", "\U0001f600", "_x_", " ", "Ω", "\x00"]


@pytest.mark.parametrize("kind", FILES)
def test_ids_equal_the_library(kind):
    plain, fast = Tokenizer.from_file(FILES[kind]), encoder(FILES[kind], kind)

    @settings(max_examples=3000, deadline=None)
    @given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.text(max_size=30)))
    def check(text):
        assert list(array("I", fast.ids(text))) == plain.encode(text, add_special_tokens=False).ids

    check()


def test_file_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_BYTES", 60)
    plain = Tokenizer.from_file(FILES["byte"])
    texts = [None, "", "a b", "x" * 5000, "hello world", "hello world", *[f"some text number {i}" for i in range(40)]]
    rows = [(100 - i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 7), (50, "a b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    target = tokenfile.new_target(spark)
    tokenfile.write(docs, target, FILES["byte"])
    got = tokenfile.read(spark, target).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(got) == len(rows)
    for r, (doc, text, _) in zip(got, order, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, list(array("I", bytes(r.ids)))) == (doc, start, len(ids), ids)
        start += len(ids)
    assert [list(array("I", x))[:-1] for x in tokenfile.fetch(spark, target, 96)] == [plain.encode("hello world", add_special_tokens=False).ids]
    empty = tokenfile.new_target(spark)
    tokenfile.write(docs.limit(0), empty, FILES["byte"])
    assert tokenfile.read(spark, empty).collect() == []


def test_query_against_the_library(spark, sf_dir):
    plain = Tokenizer.from_file(FILES["byte"])
    got = {r.doc_id: r for r in queries.op6_token_output(spark, sf_dir).collect()}
    start = 0
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = array("I", [*plain.encode(d.text or "", add_special_tokens=False).ids, 0])
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
