import hashlib
import re
from collections import Counter

import numpy as np

from factledger.llm import fingerprint, queries
from factledger.llm.common import Words

TERM = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def test_lexicon_is_the_band(spark):
    texts = ["common a1", "common a1 b2 b2", "common b2 c3", "common D4", "common, d4!", "", None, "x y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = fingerprint.lexicon(docs, 0.2, 0.5)
    df = Counter(w for t in texts for w in set(TERM.findall(low(t or ""))))
    want = [w for w, n in df.items() if n > 1 and 0.2 * 8 <= n <= 0.5 * 8]
    assert set(got.tolist()) == set(Words(want).hash.tolist()) and sorted(want) == ["a1", "b2", "d4"]


def test_fingerprints_hang_on_the_set_alone():
    lexicon = np.sort(Words([f"w{i}" for i in range(400)]).hash)
    member = fingerprint.membership(lexicon)
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, " ".join(reversed(base.split())) + " other words w3", base.replace("w50 ", ""), " ".join(f"w{i}" for i in range(200, 300)), "none here", "none  here", "", "***"]
    got = fingerprint.fingerprints(texts, lexicon, member)
    assert got[0] == got[1] and got[4] == got[5] and got[4][0] == "x" and got[6] != got[7]
    near = fingerprint.likeness(got[0], got[2])
    assert 0.5 < near < 1 and fingerprint.likeness(got[0], got[3]) < 0.5
    assert fingerprint.likeness(got[0], got[1]) == 1 and fingerprint.likeness(got[0], got[4]) == 0
    for i, t in enumerate(texts):
        assert fingerprint.fingerprints([t], lexicon, member) == [got[i]]


def sets_of(text, lexicon, member):
    """The text's terms of the whole lexicon and of each of its parts; hashes and their sums play no part."""
    own = sorted(set(TERM.findall(low(text))))
    place = {int(h): k for k, h in enumerate(lexicon)}
    at = [place[h] for h in Words(own).hash.tolist() if h in place] if own else []
    if not at:
        return None, frozenset(own) if own else text
    return [frozenset(at), *[frozenset(k for k in at if member[k, j]) for j in range(member.shape[1])]], None


def likeness_of(a, b):
    if a[0] is None or b[0] is None:
        return float(a == b)
    pairs = [(x, y) for x, y in zip(a[0][1:], b[0][1:]) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else float(a[0][0] == b[0][0])


def check(rows, docs, lexicon):
    """Hashes are equal where sets are and only there; all else is worked out from sets and texts."""
    member = fingerprint.membership(lexicon)
    docs = sorted(((i, t or "") for i, t in docs if i is not None))
    want, seen = [], {}
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt))
    got = sorted(rows, key=lambda r: (r.doc_id, r.n_chars, r.edited_sha256))
    want.sort(key=lambda x: x[:3])
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in got] == [x[:3] for x in want]
    for r, (_, _, _, t, e, nxt) in zip(got, want, strict=True):
        own, other, after = (sets_of(x, lexicon, member) for x in (t, e, nxt))
        assert abs(r.near_edited - likeness_of(own, other)) < 1e-12 and abs(r.near_next - likeness_of(own, after)) < 1e-12
        for mark, (sets, rest) in ((r.fingerprint, own), (r.edited_fingerprint, other)):
            if sets is None:
                assert mark[0] == "x" and seen.setdefault(("x", rest), mark) == mark
            else:
                parts = mark.split("-")
                assert len(parts) == len(sets)
                for j, (x, y) in enumerate(zip(parts, sets)):
                    assert (x == "0") == (not y) and seen.setdefault((j, y), x) == x
    for j in {k[0] for k in seen}:
        values = [v for k, v in seen.items() if k[0] == j and k[1]]
        assert len(values) == len(set(values))


def test_edges(spark):
    rows = [(5, "é" * 9), (3, None), (3, None), (9, "a b c d"), (7, ""), (None, "z"), (-2, "the end of it"), *[(20 + i, f"row {i} of the table") for i in range(50)]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    lexicon = fingerprint.lexicon(docs)
    check(fingerprint.fingerprint_with_next(docs, lexicon).collect(), rows, lexicon)
    one = docs.where("doc_id = 9")
    check(fingerprint.fingerprint_with_next(one, lexicon).collect(), [(9, "a b c d")], lexicon)
    empty = docs.limit(0)
    assert fingerprint.fingerprint_with_next(empty, fingerprint.lexicon(empty)).collect() == []
    assert len(fingerprint.fingerprint(docs, lexicon).collect()) == len(rows)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op9_document_fingerprints(spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], fingerprint.lexicon(docs))
