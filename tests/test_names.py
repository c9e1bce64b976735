"""Names in lines and rows like a name, against plain loops over every pair."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factledger.functions import lexicons as lx
from factledger.operators import names

from tests.test_likeness import lcs, weighted

WORDS = "red blue woven picnic basket glass jar of the set mat lantern black 24 50's garden café co. t-light".split()


def near(name, low):
    """The best stretch, the first of equals."""
    n, best = len(name), None
    for s in range(1 - n, len(low)):
        a, b = max(0, s), min(len(low), s + n)
        score = 200 * lcs(name, low[a:b]) / (n + b - a)
        if score >= 95 and (best is None or (score, -a) > best[0]):
            best = ((score, -a), a, b)
    return best and best[1:]


def plain(line, entities):
    low, out = line.lower(), []

    def put(kind, entity, start, end):
        if all(end <= a or start >= b for a, b, _ in out):
            out.append((start, end, entity))

    def whole(text):
        return [(m.start(), m.end()) for m in re.finditer(r"(?<!\w)" + re.escape(text) + r"(?!\w)", low)]

    for e in sorted(entities, key=lambda e: (-len(e), e)):
        for a, b in whole(e.lower()):
            put(0, e, a, b)
    found = sorted((e, a, b) for alias, e in [*lx.ALIASES.items(), ("us", "USA")] if e in entities for a, b in whole(alias) if alias != "us" or line[a:b] == "US")
    for e, a, b in found:
        put(1, e, a, b)
    known = {e for *_, e in out}
    for e in sorted(entities):
        words = re.findall("[a-z0-9]+", e.lower())
        if len(words) >= 2 and e not in known:
            for m in re.finditer("(?<![a-z0-9])" + "[^a-z0-9]{0,3}".join(words) + "(?![a-z0-9])", low):
                put(2, e, m.start(), m.end())
    known = {e for *_, e in out}
    for e in sorted(entities):
        if len(e) >= 8 and e not in known and (at := near(e.lower(), low)):
            put(3, e, *at)
    return sorted(out)


def spoilt(rng, text):
    b = list(text)
    for _ in range(rng.randint(1, 2)):
        b = b or ["x"]
        k = rng.randrange(len(b))
        b[k : k + 1] = rng.choice([[], [b[k], "s"], [" ", b[k]], ["/"]])
    return "".join(b)


def named(rng, n, size):
    out = {"United Kingdom", "USA", "Germany", "EIRE", "日本", "Île", "A", "24 24 mats"}
    while len(out) < n:
        out.add(" ".join(rng.choice(WORDS).upper() for _ in range(rng.randint(1, size))))
    return sorted(out)


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(11)
    tables = {f"t{k}": named(rng, 30, 5) for k in range(3)}
    lines = [("t0", "Sales in the UK and the u.k., US and us; German goods of Ireland"), ("t0", "日本 rose, 日本製 fell; Île, île-de; a A"), ("t0", "24 24 24 mats"), ("t1", ""), ("t1", "no name at all"), ("t9", "Germany")]
    for _ in range(120):
        t = rng.choice(list(tables))
        parts = [rng.choice([e, e.lower(), e.replace(" ", "  "), e.replace(" ", "/"), spoilt(rng, e), rng.choice(WORDS)]) for e in rng.sample(tables[t], 3)]
        lines.append((t, rng.choice(["- ", "", "in ", "x"]) + rng.choice([" sold more than ", ", ", " "]).join(parts) + rng.choice(["", ".", "s", " TW"])))
    own = spark.createDataFrame([(t, e) for t, x in tables.items() for e in x], "table_id string, Entity string")
    at = spark.createDataFrame([(f"n{i}", t, 0, x) for i, (t, x) in enumerate(lines)], "note_id string, table_id string, line_idx int, line string")
    return tables, lines, own, at


def test_places_of_names(cases):
    tables, lines, own, at = cases
    got = {}
    for r in names.entity_spans(at, own).collect():
        got.setdefault(int(r.note_id[1:]), []).append((r.start, r.end, r.entity))
    for i, (t, line) in enumerate(lines):
        assert sorted(got.get(i, [])) == plain(line, tables.get(t, [])), (line, tables.get(t))


def test_a_table_of_many_names_meets_few(spark):
    """10,000 names of words that each stand in twenty others: an index join, not every line against every name."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(2000)]
    entities = sorted({" ".join(rng.choice(vocabulary) for _ in range(4)) for _ in range(10_000)})
    own = spark.createDataFrame([("t", e) for e in entities], "table_id string, Entity string")
    chosen = [rng.sample(entities, 2) for _ in range(50)]
    lines = spark.createDataFrame([(f"n{i}", "t", 0, f"- {a} beat {b.upper()} TW") for i, (a, b) in enumerate(chosen)], "note_id string, table_id string, line_idx int, line string")
    got = {}
    for r in names.entity_spans(lines, own).collect():
        got.setdefault(int(r.note_id[1:]), set()).add(r.entity)
    assert got == {i: set(x) for i, x in enumerate(chosen)}
    forms = names.dictionary(own)
    words = lines.select("note_id", "table_id", F.explode(F.regexp_extract_all(F.lower("line"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("word"))
    grams = lines.select("note_id", "table_id", F.explode(F.concat(*[names._grams(F.lower("line"), n) for n in names.GRAMS])).alias("gram"))
    met = words.join(names.postings(forms), ["table_id", "word"]).count() + grams.join(names.gram_postings(forms), ["table_id", "gram"]).count()
    assert met < 0.03 * len(entities) * len(chosen)


def test_rows_like_a_name(spark):
    rng = random.Random(7)
    entities = named(rng, 60, 5)
    asked = [spoilt(rng, rng.choice(entities).lower()) for _ in range(60)] + [rng.choice(entities).lower()[3:] or "x" for _ in range(20)] + ["the garden lantern black of the set 24 red", "q", "zz zz"]
    own = spark.createDataFrame([("t", e) for e in entities], "table_id string, Entity string")
    df = spark.createDataFrame([(i, "t", x.strip()) for i, x in enumerate(asked)], "i int, table_id string, base string").where("base <> ''")
    got = {}
    for r in names.fuzzy_rows(df, own, ["i"], "base").collect():
        got.setdefault(r.i, []).append((round(r.score, 9), r.row))
    for i, x in enumerate(asked):
        scored = sorted(((-round(weighted(x.strip(), e.lower()), 9), e) for e in entities))
        top = [(-s, e) for s, e in scored if -s >= 85 and s <= scored[0][0] + 2][:5]
        assert sorted(got.get(i, [])) == sorted(top), (x, top)
