"""Claims that rules read from lines, the words beside values that correct claims, and names in lines."""

import pytest

from factledger.operators import claims, extraction, names
from factledger.operators.mentions import note_lines

from tests import made
from tests.test_likeness import weighted

NOTE_DDL = "note_id string, table_id string, note string"
CLAIM_DDL = "note_id string, table_id string, line_idx int, claim_idx int, entity string, metric string, period string, value_text string, direction string, qualifier string"
READ = [
    ("- Italy revenue was £4,410.75 TW, down 26.7% WoW", [("Italy", "revenue", "TW", "£4,410.75"), ("Italy", "revenue", "WoW", "26.7%")]),
    ("- Spain sold 3,100 units against 120 LW", [("Spain", "units", "TW", "3,100 units"), ("Spain", "units", "LW", "120")]),
    ("- Sales came to £52.3k in the UK and £8,120.55 in Spain", [("United Kingdom", "revenue", "TW", "£52.3k"), ("United Kingdom", "revenue", "TW", "£8,120.55")]),
    ("- Italy ranks 3rd with 9 orders and a share of 6.5%", [("Italy", "rank", "TW", "3rd"), ("Italy", "orders", "TW", "9"), ("Italy", "share", "TW", "6.5%")]),
    ("- Total revenue was £68.0k TW", [("TOTAL", "revenue", "TW", "£68.0k")]),
    ("- Revenue was £100", [("", "revenue", "TW", "£100")]),
    ("- Sweden orders fell 50.0% week on week; 42.1% last year", [("Sweden", "orders", "WoW", "50.0%"), ("Sweden", "orders", "LY", "42.1%")]),
    ("- Italy came 3rd, then 5", [("Italy", "rank", "TW", "3rd"), ("Italy", "revenue", "TW", "5")]),
    ("- In 2011 the top 3 were ahead", []),
]


@pytest.fixture(scope="module")
def tables(spark):
    return made.tables(spark).cache()


def test_claims_read_by_rules(spark, tables):
    notes = spark.createDataFrame([(f"n{i:02}", "aliased", t) for i, (t, _) in enumerate(READ)], NOTE_DDL)
    got = {}
    for r in claims.note_claims(notes, tables).orderBy("note_id", "claim_idx").collect():
        got.setdefault(r.note_id, []).append((r.entity, r.metric, r.period, r.value_text))
    for i, (text, want) in enumerate(READ):
        mine = [(e, m, p, v.replace(" units", "")) for e, m, p, v in got.get(f"n{i:02}", [])]
        assert mine == [(e, m, p, v.replace(" units", "")) for e, m, p, v in want], text


# line, claims of it (metric, period, value, qualifier), and (metric, period, qualifier) after the hints
HINTS = [
    ("- Italy revenue was £6,020.30 LW", [("revenue", "TW", "£6,020.30", "none")], [("revenue", "LW", "none")]),
    ("- Italy took 9 orders TW", [("units", "TW", "9", "none")], [("orders", "TW", "none")]),
    ("- A price of £9.33, and 33 units", [("orders", "TW", "33", "none")], [("units", "TW", "none")]),
    ("- A decline of £8,889.85", [("revenue", "TW", "£8,889.85", "none")], [("revenue", "WoW", "none")]),
    ("- A gain of £4,510.30 on LY", [("revenue", "TW", "£4,510.30", "none")], [("revenue", "YoY", "none")]),
    ("- Up £7,770.35 versus LW", [("revenue", "TW", "£7,770.35", "none")], [("revenue", "WoW", "none")]),
    ("- It took £4,410.75 versus LW £6,020.30", [("revenue", "TW", "£4,410.75", "none"), ("revenue", "TW", "£6,020.30", "none")], [("revenue", "TW", "none"), ("revenue", "LW", "none")]),
    ("- From £6,020.30 on LW", [("revenue", "LW", "£6,020.30", "none")], [("revenue", "LW", "none")]),
    ("- 5 orders, then 5 units", [("revenue", "TW", "5", "none"), ("revenue", "TW", "5", "none")], [("orders", "TW", "none"), ("units", "TW", "none")]),
    ("- About £4.4k TW", [("revenue", "TW", "£4.4k", "none")], [("revenue", "TW", "approx")]),
    ("- 26.7% WoW", [("revenue", "YoY", "26.7%", "none")], [("revenue", "WoW", "none")]),
    ("- 26.7% share", [("revenue", "TW", "26.7%", "over")], [("share", "TW", "over")]),
    ("- LW: £6,020.30", [("revenue", "TW", "£6,020.30", "none")], [("revenue", "LW", "none")]),
    ("- It was 3.1x LW", [("revenue", "WoW", "3.1x", "none")], [("revenue", "WoW", "none")]),
    ("- nothing of it here", [("revenue", "TW", "£1", "none")], [("revenue", "TW", "none")]),
]


def test_hints(spark):
    lines = note_lines(spark.createDataFrame([(f"n{i:02}", "t", t) for i, (t, _, _) in enumerate(HINTS)], NOTE_DDL))
    said = spark.createDataFrame([(f"n{i:02}", "t", 0, k, "Italy", m, p, v, "none", q) for i, (_, c, _) in enumerate(HINTS) for k, (m, p, v, q) in enumerate(c)], CLAIM_DDL)
    got = {}
    for r in extraction.hinted(said, lines, claims.values_of(said)).orderBy("note_id", "claim_idx").collect():
        got.setdefault(r.note_id, []).append(((r.metric, r.period, r.qualifier), r.adjusted))
    for i, (text, before, want) in enumerate(HINTS):
        assert [x for x, _ in got[f"n{i:02}"]] == want, text
        assert [bool(a) for _, a in got[f"n{i:02}"]] == [(m, p, q) != w for (m, p, _, q), w in zip(before, want)], text


def test_level_2_from_the_note_alone(spark, tables):
    row = {r.Entity: r for r in tables.where("table_id = 'aliased'").collect()}
    italy, spain = row["Italy"], row["Spain"]
    text = f"- Italy revenue was {made.money(italy.Revenue_TW)} TW, {made.change(italy.WoW_Pct)} WoW\n- Sweden revenue was {made.money(spain.Revenue_TW)} TW\n- Spain took {italy.Orders_TW} orders TW"
    got = {(r.line_idx, r.value_text.strip()): r.label for r in claims.level2(spark.createDataFrame([("a", "aliased", text)], NOTE_DDL), tables).collect()}
    assert got[0, made.money(italy.Revenue_TW)] == "Correct" and got[0, f"{abs(italy.WoW_Pct):.1f}%"] == "Correct"
    assert got[1, made.money(spain.Revenue_TW)] == "Wrong_entity" and [v for (i, _), v in got.items() if i == 2] == ["Wrong_entity"]


def test_fuzzy_rows_against_brute_force(spark, tables):
    rows = [(r.table_id, r.Entity) for r in tables.select("table_id", "Entity").collect()]
    asked = [("aliased", x) for x in ("portugall", "spian", "unitd kingdom", "kingdom united", "itly", "zzz")] + [("lamps", x) for x in ("harbour lamp grey", "lamp harbour teal", "harbour lmp", "meadow rug", "meadow rugs narrow one")]
    df = spark.createDataFrame([(f"n{i}", 0, 0, t, x) for i, (t, x) in enumerate(asked)], "note_id string, line_idx int, claim_idx int, table_id string, base string")
    got = {}
    for r in names.fuzzy_rows(df, tables, ["note_id", "line_idx", "claim_idx"], "base").collect():
        got.setdefault(r.note_id, set()).add((r.row, round(r.score, 6)))
    for i, (t, x) in enumerate(asked):
        scores = sorted(((weighted(x, e.lower()), e) for u, e in rows if u == t), key=lambda s: (-s[0], s[1]))
        scores = [s for s in scores if s[0] >= 85]
        want = {(e, round(s, 6)) for s, e in scores if s >= scores[0][0] - 2}
        assert got.get(f"n{i}", set()) == want, x


@pytest.mark.parametrize("line,want", [
    ("- HARBOUR LAMP TEAL and harbour lamp ivory", ["HARBOUR LAMP TEAL", "harbour lamp ivory"]),
    ("- Harbour  Lamp/Slate", ["Harbour  Lamp/Slate"]),
    ("- HARBOUR LAMPP SLATE", []),  # 94.4 at best: letters may change by one in ten of both
    ("- HARBOUR LAMP", []),
    ("- meadow rug narrowest", ["meadow rug narrow"]),
])
def test_places_of_names(spark, tables, line, want):
    lines = note_lines(spark.createDataFrame([("a", "lamps", line)], NOTE_DDL))
    rows = sorted((r.start, r.end) for r in names.entity_spans(lines, tables).collect())
    text = lines.first().line
    assert [text[a:b] for a, b in rows] == want


def test_a_longer_name_takes_its_room_first(spark):
    own = spark.createDataFrame([("t", "Guinea"), ("t", "New Guinea"), ("t", "USA")], "table_id string, Entity string")
    lines = note_lines(spark.createDataFrame([("a", "t", "New Guinea beat Guinea, not us, but the US and American goods")], NOTE_DDL))
    rows = sorted((r.start, r.entity) for r in names.entity_spans(lines, own).collect())
    assert [e for _, e in rows] == ["New Guinea", "Guinea", "USA", "USA"]
