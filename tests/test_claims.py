"""Claims written from the rows of made tables: each label follows from what the claim was written from."""

import pytest
from pyspark.sql import functions as F

from factledger.operators import claims
from factledger.operators.mentions import note_lines

from tests import made
from tests.made import change, money, ordinal


@pytest.fixture(scope="module")
def tables(spark):
    return made.tables(spark).cache()


def claims_of(table, rows):
    """(line, entity, metric, period, value, direction, label) of each row, and of the whole table."""
    for k, r in enumerate(rows):
        other, e = rows[(k + 3) % len(rows)], r.Entity
        yield "", e, "revenue", "TW", money(r.Revenue_TW), "none", "Correct"
        yield "", e.upper(), "revenue", "TW", f"£{r.Revenue_TW / 1000:.1f}k", "up", "Correct"
        yield "", e, "units", "TW", f"{r.Units_TW:,} units", "none", "Correct"
        yield "", e, "rank", "TW", ordinal(r.Rank), "none", "Correct"
        yield "", e, "rank", "TW", str(r.Rank), "none", "Correct"
        yield "", e, "rank", "TW", ordinal(other.Rank), "none", "Wrong_value"
        yield "", e, "share", "TW", f"{r.Share_Pct:.1f}%", "none", "Correct"
        yield "", e, "revenue", "TW", money(other.Revenue_TW), "none", "Wrong_entity"
        yield f"- {e} took {money(r.Revenue_TW * 1.37 + 0.11)} TW", e, "revenue", "TW", money(r.Revenue_TW * 1.37 + 0.11), "none", "Wrong_value"
        yield "", e, "revenue", "TW", "hardly anything", "none", "Unverifiable"
        yield "", f"Nether {k}{k}x", "revenue", "TW", money(r.Revenue_TW), "none", "Unverifiable"
        if r.WoW_Pct is not None:
            yield "", e, "revenue", "TW", money(r.Revenue_LW), "none", "Wrong_metric"
            yield "", e, "revenue", "LW", money(r.Revenue_LW), "none", "Correct"
            yield "", e, "revenue", "WoW", f"{r.WoW_Pct:+.1f}%", "none", "Correct"
            yield f"- {e} was {change(r.WoW_Pct)} WoW", e, "revenue", "WoW", f"{abs(r.WoW_Pct):.1f}%", "up" if r.WoW_Pct >= 0 else "down", "Correct"
            yield "", e, "revenue", "WoW", f"{-r.WoW_Pct:+.1f}%", "none", "Wrong_value"
    yield "", "Total", "revenue", "TW", money(sum(r.Revenue_TW for r in rows)), "none", "Correct"
    yield "", "all markets", "units", "LW", f"{sum(r.Units_LW for r in rows):,} units", "none", "Correct"


@pytest.fixture(scope="module")
def found(spark, tables):
    rows = {}
    for r in tables.orderBy("table_id", "Rank").collect():
        rows.setdefault(r.table_id, []).append(r)
    out = [(t, *x) for t in ("markets", "lamps", "aliased") for x in claims_of(t, rows[t])]
    lamps = sum(r.Revenue_TW for r in rows["lamps"] if "HARBOUR" in r.Entity)
    line = f"- The HARBOUR LAMP lines took {money(lamps)} TW"
    uk = next(r for r in rows["aliased"] if r.Entity == "United Kingdom")
    slate = next(r for r in rows["lamps"] if r.Entity == "HARBOUR LAMP SLATE")
    out += [
        ("lamps", line, "GROUP", "revenue", "TW", money(lamps), "none", "Correct"), ("lamps", line, "GROUP", "revenue", "TW", money(lamps + 1234.5), "none", "Wrong_value"), ("lamps", "", "GROUP", "revenue", "TW", money(lamps), "none", "Unverifiable"),
        ("lamps", line, "TOTAL", "revenue", "TW", money(lamps), "none", "Correct"), ("aliased", "", "the UK", "revenue", "TW", money(uk.Revenue_TW), "none", "Correct"), ("aliased", "", "Britain", "revenue", "TW", money(uk.Revenue_TW), "none", "Correct"),
        ("lamps", "", "Slate harbour lamp", "revenue", "TW", money(slate.Revenue_TW), "none", "Correct"), ("lamps", "", "HARBOR LAMP SLATE", "revenue", "TW", money(slate.Revenue_TW), "none", "Correct"),
        ("lamps", "", "HARBOR LAMP SLATE", "revenue", "TW", money(slate.Revenue_TW * 1.5 + 1.01), "none", "Unverifiable"),
    ]
    lines = note_lines(spark.createDataFrame([(f"n{i}", x[0], x[1]) for i, x in enumerate(out)], "note_id string, table_id string, note string"))
    said = spark.createDataFrame([(f"n{i}", x[0], 0, 0, *x[2:7], "none") for i, x in enumerate(out)], "note_id string, table_id string, line_idx int, claim_idx int, entity string, metric string, period string, value_text string, direction string, qualifier string")
    labelled = claims.verify(said, lines, tables).cache()
    return out, {int(r.note_id[1:]): r.label for r in labelled.collect()}, labelled


def test_labels(found):
    out, got, _ = found
    wrong = [(x, got.get(i)) for i, x in enumerate(out) if got.get(i) != x[-1]]
    assert not wrong and len(out) > 250


def test_rates(found):
    out, _, labelled = found
    rates = claims.claim_rates(labelled.withColumn("note_id", F.lit("all")).where("table_id = 'markets'").withColumn("table_id", F.lit("t"))).first()
    labels = [x[-1] for x in out if x[0] == "markets"]
    wrong, binding = sum(x.startswith("Wrong") for x in labels), sum(x in ("Wrong_entity", "Wrong_metric") for x in labels)
    n = wrong + labels.count("Correct")
    assert rates.claim_error_rate == pytest.approx(wrong / n) and rates.binding_error_rate == pytest.approx(binding / n)
