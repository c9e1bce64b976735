import base64
import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factledger.llm import queries, secrets

WORDS = secrets.automaton()
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


PIECES = ["token", "PASSWORD", "api_key", "apikey", "=", ": ", '"', "secret", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\U0001f600", " ", "İ", "K", "_.=-", "x" * 13, "passwd"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_base_spans_equal_a_plain_scan(text):
    assert [x for x in secrets.scan(text, WORDS) if x[2] in ("assign", "access", "hex")] == brute(text)


def test_checksum_decides():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"x ghp_{body}{secrets.crc_base62(body)} y"
    assert [x[2] for x in secrets.scan(good, WORDS) if x[2] == "github"] == ["github"]
    assert not [x for x in secrets.scan(good.replace("A1b2", "A1b3"), WORDS) if x[2] == "github"]
    assert [x[2] for x in secrets.scan("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc", WORDS)] == ["jwt"]
    assert not secrets.scan("eyJub3Rqc29u.eyJzdWIiOiIxIn0.abc", WORDS)


def test_nulls_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "token = abcdefghijkl", "c"), (3, "token = abcdefghijkl", "c"), (None, "x", "d")], "doc_id long, text string, spans string")
    rows = secrets.find_secrets(docs, replace=True).collect()
    assert sorted((r.doc_id or 0, len(r.spans), r.text) for r in rows if r.text is not None) == [(0, 0, "x"), (2, 0, ""), (3, 1, "<assign>"), (3, 1, "<assign>")]
    assert [r.text for r in rows if r.doc_id == 1] == [None]
    assert secrets.find_secrets(docs.limit(0)).collect() == []


def test_query_against_a_plain_scan(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op4_secret_scan(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans = brute(d.text or "")
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


@pytest.mark.parametrize("text", ["token = " + "a" * 11, "AKIA" + "A" * 13, "0123456789abcde"])
def test_short_matches_are_dropped(text):
    assert secrets.scan(text, WORDS) == []


def test_time_grows_with_the_length_alone():
    """Texts that are made to be tried at every place: four times the length takes about four times, not sixteen."""
    words = secrets.automaton()
    for unit in ("eyJ", "eyJa.", "eyJ.eyJ", "AKIA", "token", "token ", "sk_live_", "xoxb-12345678-", "npm_", "ghp_", "-----BEGIN PRIVATE KEY-----", "AIza", "0123456789abcdef", "secret=a "):
        took = []
        for size in (60_000, 240_000):
            text = unit * (size // len(unit))
            began = time.process_time()
            secrets.scan(text, words)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.1, (unit, took)


def test_tokens_after_a_failed_one():
    head = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    good = f"{head}.eyJhIjoxfQ.c2ln"
    for before in ("eyJx ", "eyJx.eyJ ", "eyJxeyJ. ", "eyJa.b "):
        spans = [x for x in secrets.scan(before + good, secrets.automaton()) if x[2] == "jwt"]
        assert spans == [(len(before), len(before) + len(good), "jwt")]


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghijkl", 5, 6)], "doc_id long, text string, spans int, id int")
    got = secrets.find_secrets(docs, replace=True, keep=["spans", "id"], spans_name="_spans").first()
    assert (got.spans, got.id, len(got._spans), got.text) == (5, 6, 1, "<assign>")
