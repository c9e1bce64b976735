"""Sentences with the reading that they must get."""

import re
import time

import pytest

from factledger.functions import lexicons as lx
from factledger.operators.mentions import mentions, note_lines
from factledger.plans import catalogue

CASES = [
    ("Revenue was £12,345.67 this week", [("£12,345.67", "currency", 12345.67, False, "")]),
    ("WoW change of -15.9%", [("-15.9%", "percent", -15.9, True, "")]),
    ("UK revenue £89.8k", [("£89.8k", "currency", 89800.0, False, "")]),
    ("about $3bn in sales", [("$3bn", "currency", 3e9, False, "")]),
    ("share rose 2.1 percentage points", [("2.1 percentage points", "percent", 2.1, True, "")]),
    ("a 4 percent gain", [("4 percent", "percent", 4.0, True, "")]),
    ("Germany revenue fell 27.0% WoW", [("27.0%", "percent", -27.0, True, "")]),
    ("UK revenue grew 20.5% YoY", [("20.5%", "percent", 20.5, True, "")]),
    ("France posted an 85.1% decline WoW", [("85.1%", "percent", -85.1, True, "")]),
    ("Germany revenue fell to £2,840.80", [("£2,840.80", "currency", 2840.8, False, "")]),
    ("UK sold 44,149 units", [("44,149", "count", 44149.0, False, "")]),
    ("Germany ranked 3rd by revenue TW", [("3rd", "count", 3.0, False, "")]),
    ("They hold ranks 1 to 5", [("1", "count", 1.0, False, ""), ("5", "count", 5.0, False, "")]),
    ("The top 3 markets in week 42 of 2011", [("3", "plain", 3.0, False, "counting"), ("42", "plain", 42.0, False, "date_or_week"), ("2011", "plain", 2011.0, False, "year")]),
    ("2 of the 5 countries grew WoW", [("2", "plain", 2.0, False, "counting"), ("5", "plain", 5.0, False, "counting")]),
    ("Sales gave up £2k", [("£2k", "currency", -2000.0, True, "")]),
    ("It made up 40% of sales", [("40%", "percent", 40.0, False, "")]),
    ("0.3% above LY", [("0.3%", "percent", 0.3, True, "")]),
    ("it was 3.8x LW", [("3.8x", "plain", 3.8, False, "")]),
    ("It is No.3 here", [("3", "count", 3.0, False, "")]),
]


@pytest.fixture(scope="module")
def found(spark):
    notes = spark.createDataFrame([(f"n{i:02}", "t", f"\n- {text}\n\n") for i, (text, _) in enumerate(CASES)], "note_id string, table_id string, note string")
    out = {}
    for r in mentions(note_lines(notes)).orderBy("note_id", "mention_idx").collect():
        out.setdefault(r.note_id, []).append(r)
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_reading(found, i):
    rows = found[f"n{i:02}"]
    assert [(r.raw_text, r.unit, round(r.value, 6), r.signed, r.skip_reason) for r in rows] == CASES[i][1]
    for r in rows:
        assert r.line_idx == 0 and r.raw_text in r.line[r.position : r.end]


def test_hedges_and_ranges(spark):
    notes = spark.createDataFrame([("a", "t", "nearly £4k\nmore than 900%\nless than 5 orders\njust over 3%\nc.£4k\n£4k"), ("b", "t", None), ("c", "t", "")], "note_id string, table_id string, note string")
    rows = mentions(note_lines(notes)).orderBy("line_idx").collect()
    assert [r.qualifier for r in rows] == ["approx", "over", "under", "approx", "approx", "none"]


def test_documents_against_the_same_pattern_in_python(spark, sf_dir):
    pattern = re.compile(lx.NUMBER.replace("(?U)", ""))
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        for k, line in enumerate(x for x in re.split(r"\r?\n", r.text or "") if x.strip(" ")):
            for part in re.split(lx.SENTENCE_END, line):
                want[r.doc_id, k] = want.get((r.doc_id, k), []) + [m[0].strip() for m in pattern.finditer(part)]
    got = {}
    for r in catalogue.extract_numbers_docs(spark, sf_dir).orderBy("doc_id", "line_idx", "mention_idx").collect():
        got.setdefault((r.doc_id, r.line_idx), []).append(r.raw_text)
    assert got == {k: v for k, v in want.items() if v}


def test_work_grows_with_the_line(spark):
    """Four times the numbers in a line cost no more than six times as long (16 times if each looked at the whole line)."""
    took = {}
    for n in (100, 300, 1200):
        line = "- " + " then ".join(f"£{i},000.50 up {i % 90}.5% in week {i % 52}" for i in range(1, n + 1))
        notes = spark.createDataFrame([("n", "t", line)], "note_id string, table_id string, note string")
        began = time.time()
        got = sorted(mentions(note_lines(notes)).select("mention_idx", "position", "end", "raw_text", "unit", "direction", "skip_reason").collect())
        took[n] = time.time() - began
        assert [r.mention_idx for r in got] == list(range(3 * n))
        assert all(line[r.position : r.end].strip() == r.raw_text for r in got)
        assert {r.skip_reason for r in got[2::3]} == {"date_or_week"}
        assert {(r.unit, r.direction) for r in got[1::3]} == {("percent", "up")}
    assert took[1200] < 6 * max(took[300], 2)


def test_lines_without_digit_are_left_out_first(spark):
    notes = spark.createDataFrame([("a", "t", "no number\n\nIt rose to £5\nnone. Here neither"), ("b", "t", "-")], "note_id string, table_id string, note string")
    found = mentions(note_lines(notes))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Before anything else looks at the lines.
    assert r"(?U)\d" in plan[plan.rindex("Filter") :], plan
    assert [(r.note_id, r.line_idx, r.raw_text) for r in found.collect()] == [("a", 1, "£5")]


def test_a_number_is_matched_once_for_all_its_parts(spark):
    """Each part of a reading is worked out once: the plan holds few copies of the pattern of numbers."""
    notes = spark.createDataFrame([("a", "t", "£5")], "note_id string, table_id string, note string")
    plan = mentions(note_lines(notes))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("percentage") <= 4


def test_words_far_away_and_letters_for_private_use(spark):
    """The nearest words are those of the whole stretch, wherever a shorter one would cut it."""
    far = "gave " + "x" * 70 + "-up up 5%"
    texts = [
        far, "gave" + " " * 80 + "up 5%", "more" + " " * 70 + "than £5", "about5 and £6k. The 7%", "£8 " + "." * 80 + " units", "sales rose " + ", ".join(["word"] * 30) + " 9%",
    ]
    notes = spark.createDataFrame([(f"n{i}", "t", x) for i, x in enumerate(texts)], "note_id string, table_id string, note string")
    got = [(r.note_id, r.raw_text, r.direction, r.qualifier, r.position) for r in mentions(note_lines(notes)).orderBy("note_id", "mention_idx").collect()]
    assert got == [
        ("n0", "5%", "up", "none", 82), ("n1", "5%", "down", "none", 87), ("n2", "£5", "none", "over", 79), ("n3", "5", "none", "approx", 6), ("n3", "£6", "none", "none", 13), ("n3", "7", "none", "none", 24),
        ("n4", "£8", "none", "none", 0), ("n5", "9%", "none", "none", 190),
    ]
