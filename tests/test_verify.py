"""Drafts, repairs and re-gating over the report of the smallest data."""

import pytest
from pyspark.sql import functions as F

from factledger.operators import gate, verify
from factledger.operators.mentions import mentions
from factledger.plans import gate_queries
from factledger.sources.scratch import stored


@pytest.fixture(scope="module")
def made(spark, sf_dir):
    tables = stored(gate_queries._tables(spark, sf_dir).where("table_id < '1996'"), "tables")
    return tables, stored(verify.drafts(tables, {"S1": 40, "S4": 3}), "slots")


def test_what_is_planted(made):
    _, slots = made
    rows = slots.collect()
    assert {r.planted for r in rows} == {"none", "drift", "swap", "flip"}
    for r in rows:
        if r.planted == "flip":
            assert r.slot == 1 and r.value == -r.truth
        elif r.planted == "drift":
            assert min(abs(r.value - r.truth * f) for f in verify.FACTORS) < 1e-6 * abs(r.truth) + 1e-9
        elif r.planted == "none":
            assert r.value == r.truth
    share = lambda s: sum(r.planted != "none" for r in rows if r.strategy == s) / sum(r.strategy == s for r in rows)
    assert share("S1") > 0.25 > 0.1 > share("S4")


def test_rounds_fall_and_only_changed_lines_change(made):
    tables, slots = made
    labels = verify.verified(slots.where("strategy = 'S1'"), tables)
    rates = {r["round"]: r.n_unsupported for r in verify.round_rates(labels).collect()}
    assert rates[0] > rates[1] >= rates[max(rates)]
    assert len({x.count() for x in labels}) == 1
    flagged = {(r.note_id, r.line_idx) for r in labels[0].where("label = 'Unsupported'").collect()}
    key = [*verify.LINE, "mention_idx"]
    moved = labels[0].alias("a").join(labels[1].alias("b"), key).where("a.raw_text <> b.raw_text").select(*verify.LINE).distinct().collect()
    assert {tuple(r) for r in moved} <= flagged


def test_regating_equals_gating_all_anew(made):
    tables, slots = made
    right, changed = verify.substituted(slots)
    before = verify.gated(slots, tables)
    after = verify.regated(before, stored(changed, "changed"), tables)
    anew = verify.gated(right, tables)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, anew.collect()))
    assert after.where("label = 'Unsupported'").count() == 0 < before.where("label = 'Unsupported'").count()


def test_versions_of_the_rules(spark, made):
    tables, _ = made
    first = tables.orderBy("table_id", "Rank").first()
    note = f"- {first.Entity} was about £{first.Revenue_TW * 1.04:,.2f} TW, exactly £{first.Revenue_TW + 0.03:,.2f} TW"
    lines = spark.createDataFrame([("n", first.table_id, 0, note)], "note_id string, table_id string, line_idx int, line string")
    rules = [gate.Rule(), gate.Rule("plain", hedged=False), gate.Rule("loose", rounding=12.0)]
    got = {(r.version, r.mention_idx): r.label for r in gate.level1_versions(mentions(lines), lines, tables, rules).collect()}
    supported = {k for k, v in got.items() if v.startswith("Supported")}
    assert supported == {("current", 0), ("loose", 0), ("loose", 1)} and len(got) == 6
    current = {r.mention_idx: r.label for r in gate.level1(mentions(lines), lines, tables).collect()}
    assert current == {i: got["current", i] for i in (0, 1)}


def test_injected_errors_are_counted_by_kind(made):
    tables, _ = made
    slots = stored(verify.injected(tables, 3), "slots")
    labels = verify.gated(slots, tables)
    got = {r.planted: r for r in verify.detection(slots, labels).collect()}
    flags = {(r.note_id, r.line_idx, r.mention_idx) for r in labels.where("label = 'Unsupported'").collect()}
    want = {}
    for r in slots.collect():
        n, k = want.get(r.planted, (0, 0))
        want[r.planted] = (n + 1, k + ((r.note_id, r.line_idx, r.slot) in flags))
    assert {k: (r.n, r.flagged) for k, r in got.items()} == want
    assert all(r.low <= r.rate <= r.high for r in got.values())
    assert got["none"].rate == 0 and got["drift"].rate > 0.8
    # The copies differ from each other.
    assert len({tuple(sorted((r.table_id, r.line_idx, r.slot, r.planted) for r in slots.where(f"strategy = 'M{k}'").collect())) for k in range(3)}) == 3
