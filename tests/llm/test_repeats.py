import random
import re
from collections import defaultdict

import numpy as np

from factledger.llm import queries, repeats

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
END = 22  # words that a shared stretch may lose at each end: those of the unit that it begins or ends in, and three


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def words(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(low(text or ""))]


def rows_of(df):
    return sorted((r.doc_id, r.start, r.end, r.n_words, tuple(r.kept_doc_ids)) for r in df.collect())


def sound(docs, got, n=3):
    """Whether each word of each passage is in a run of n words that stands before, in an earlier text or earlier in this
    one; at a passage's ends shorter units may stand. Plain n-grams: nothing is shared with the operator."""
    first = {}
    texts = {i: words(t) for i, t in docs}
    for i in sorted(texts):
        w = [x[0] for x in texts[i]]
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
    for i, start, end, n_words, kept in got:
        inside = [k for k, (_, a, b) in enumerate(texts[i]) if a >= start and b <= end]
        assert len(inside) == n_words and texts[i][inside[0]][1] == start and texts[i][inside[-1]][2] == end
        w = [x[0] for x in texts[i]]
        covered = set()
        for k in range(max(0, inside[0] - n), min(len(w) - n, inside[-1]) + 1):
            if first[tuple(w[k : k + n])] < (i, k):
                covered |= set(range(k, k + n))
        assert set(inside[2:-2]) <= covered, (i, start, end)
        assert all(x <= i for x in kept)


def test_passages_at_any_word(spark):
    """Stretches of 51 words or more at random places, inside sentences and lines, in other case and with other marks."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    word = lambda: rng.choice(vocabulary)
    text = lambda n: " ".join(word() + rng.choice(["", "", "", "", ",", ".", "\n", "!"]) for _ in range(n))
    docs, places = [], {}
    for k in range(150):
        size = rng.choice([51, 60, 90])
        passage = text(size).rstrip(",.!\n")
        for i in (k, 1000 + k):
            before = text(rng.randint(0, 60))
            own = passage if i == k else passage.upper().replace("É", "é")
            docs.append((i, f"{before} {own} {text(rng.randint(0, 60))}"))
            places[i] = (len(before) + 1, len(before) + 1 + len(passage))
    table = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, start int")
    got = rows_of(repeats.repeated_passages(table))
    sound(docs, got)
    by_doc = {r[0]: r for r in got}
    assert set(by_doc) == {1000 + k for k in range(150)}
    for i, r in by_doc.items():
        own = [x for x in words(dict(docs)[i]) if places[i][0] <= x[1] and x[2] <= places[i][1]]
        assert r[1] <= own[END][1] and r[2] >= own[-1 - END][2] and r[4] == (i - 1000,)
    clean = {r.doc_id: (r.text, r.removed) for r in repeats.without_repeats(table).collect()}
    for i, t in docs:
        cuts = [(a, b) for d, a, b, _, _ in got if d == i]
        at, kept = 0, ""
        for a, b in cuts:
            kept, at = kept + t[at:a], b
        assert clean[i][0] == kept + t[at:] and [tuple(x) for x in clean[i][1] or []] == cuts


def test_units_hang_on_their_words_alone():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(500)]
    shared = " ".join(rng.choice(vocabulary, 200))
    seen = []
    for _ in range(20):
        before = " ".join(rng.choice(vocabulary, rng.integers(0, 50)))
        u = repeats.units([before + " " + shared, "another text"])
        own = (u["doc"] == 0) & ~u["whole"]
        n = len(before.split())
        at = u["word"][own] - n
        seen.append({(int(a), int(s), int(d)) for a, s, d in zip(at, u["n_words"][own], u["d1"][own]) if END <= a and a + s <= 200 - END})
    assert all(x == seen[0] for x in seen) and len(seen[0]) > 15


def test_edges(spark):
    line = " ".join(f"w{i}" for i in range(22)) + "."
    docs = spark.createDataFrame([(1, line), (1, line), (2, None), (3, ""), (4, f"{line}\n{line}"), (None, line), (5, "short line."), (6, "short line."), (7, "same " * 100)], "doc_id long, text string")
    got = rows_of(repeats.repeated_passages(docs))
    assert got[0] == (4, 0, 2 * len(line), 44, (1,))
    assert [r[0] for r in got] == [4, 7] and got[1][3] >= 60
    assert repeats.repeated_passages(docs.limit(0)).collect() == []
    assert sorted((r.doc_id or 0, r.text) for r in repeats.without_repeats(docs).collect() if r.text is not None)[:2] == [(0, line), (1, line)]


def test_whole_lines_alone(spark):
    line = "One line of fifteen words in all: it stands quite alone here, and nothing else does!"
    docs = [(i, f"two words own{i}\n{line if i % 2 else line.upper()}\nown{i} words only a part after it") for i in range(4)]
    docs += [(9, f"two words\n{line} but longer"), (10, "two words\nthree words here"), (11, "three words here")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(repeats.repeated_passages(table))
    assert [r[:4] for r in got] == [(i, 15, 15 + len(line) - 1, len(words(line))) for i in range(1, 4)]
    assert all(r[4][0] == 0 for r in got)
    short = rows_of(repeats.repeated_passages(table, least_line=3))
    assert (11, 0, 16, 3, (10,)) in short


def test_hot_digests_give_the_same_rows(spark):
    """Every digest above the limit is broadcast, every one below it is shuffled; the rows are the same."""
    rng = random.Random(6)
    common = " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    docs = spark.createDataFrame([(i, f"a{i} b{i} {common if i % 3 else ''} c{i} d{i % 7}") for i in range(120)], "doc_id long, text string")
    assert rows_of(repeats.repeated_passages(docs, hot=0.0)) == rows_of(repeats.repeated_passages(docs, hot=1.0))


def test_query(spark, sf_dir):
    """Passages are sound by plain n-grams; every whole line that repeats is found, and every text that stands twice."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(queries.op1_substring_dedup(spark, sf_dir))
    sound(docs, got)
    spans = defaultdict(list)
    for i, a, b, _, _ in got:
        spans[i].append((a, b))
    seen = set()
    for i, t in sorted(docs):
        at = 0
        for line in t.split("\n"):
            own = words(line)
            key = tuple(x[0] for x in own)
            if len(own) >= repeats.LEAST_LINE and key in seen:
                assert any(a <= at + own[0][1] and at + own[-1][2] <= b for a, b in spans[i]), (i, line)
            seen.add(key)
            at += len(line) + 1


def test_very_long_text(spark):
    rng = random.Random(1)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, "before " + long[: len(long) // 2])], "doc_id long, text string")
    got = rows_of(repeats.repeated_passages(docs))
    assert [r[0] for r in got] == [2] and got[0][3] >= 150_000 - 2 * END
