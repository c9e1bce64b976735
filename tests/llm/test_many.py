from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from factledger.llm import encode
from factledger.llm.encode import Encoder
from tests.llm.test_tokens import FILES, PIECES


@pytest.mark.parametrize("kind", FILES)
def test_ids_of_many_texts_equal_the_library(kind, monkeypatch):
    monkeypatch.setattr(encode, "KEPT", 20)
    plain, fast = Tokenizer.from_file(FILES[kind]), Encoder(FILES[kind], kind)
    text = st.one_of(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.lists(st.sampled_from(["a", " b", "\n", " Élan", "7", " -", "ÿ×", "<", "|", " "]), max_size=12).map("".join), st.text(max_size=30))

    @settings(max_examples=1000, deadline=None)
    @given(st.lists(text, max_size=6))
    def check(texts):
        assert [list(array("I", x)) for x in fast.many(texts, b"\0" * 4)] == [[*plain.encode(x, add_special_tokens=False).ids, 0] for x in texts]

    check()


def test_a_run_is_looked_up_once_in_a_slice():
    fast, asked = Encoder(FILES["byte"], "byte"), []

    class Counted(encode.ByteRuns):
        def __getitem__(self, run):
            asked.append(run)
            return super().__getitem__(run)

    fast.byte_runs = Counted(fast.tokenizer, b"")
    texts = ["one two\none two", "one two", ""] * 50
    assert fast.many(texts) == [fast.ids(x) for x in texts]
    assert sorted(asked) == [b"\0", b"\n", b" two", b"one"]
