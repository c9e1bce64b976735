"""Template notes about report tables with planted errors: the source of gate queries, tests and benchmarks.

Every slot's true value is known, and what is planted is drawn by md5, so any engine can repeat a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 18  # per cent of slots that get an error


def as_tables(report: DataFrame) -> DataFrame:
    """Report rows under the names that the gate reads."""
    names = {"revenue_tw": "Revenue_TW", "revenue_lw": "Revenue_LW", "revenue_ly": "Revenue_LY", "units_tw": "Units_TW", "units_lw": "Units_LW", "orders_tw": "Orders_TW", "orders_lw": "Orders_LW", "wow_pct": "WoW_Pct", "yoy_pct": "YoY_Pct", "share_pct": "Share_Pct", "rank": "Rank", "entity": "Entity", "week": "table_id"}
    return report.select(*[F.col(a).alias(b) for a, b in names.items()])


def _drawn(slot: str, below: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(slot), "table_id", "Entity")), 1, 8), 16, 10).cast("long"), F.lit(below))


def template_notes(tables: DataFrame, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """``note_id``, ``table_id``, ``note``; and the slots: ``note_id``, ``table_id``,
    ``line_idx``, ``Entity``, ``text``, ``planted``, ``true_value``.

    One line for each of the first entities: its revenue and its change since last week. An error drifts the revenue by
    6 per cent, or turns the sign of the change."""
    rows = tables.where((F.col("Rank") <= top) & F.col("WoW_Pct").isNotNull())
    draw = _drawn("slot", 100)
    drift, flip = draw < RATE // 2, (draw >= RATE // 2) & (draw < RATE)
    money = F.concat(F.lit("£"), F.format_number(F.col("Revenue_TW") * F.when(drift, 1.06).otherwise(1.0), 2))
    up = (F.col("WoW_Pct") >= 0) != flip
    text = F.concat(F.lit("- "), "Entity", F.lit(" revenue was "), money, F.lit(" TW, "), F.when(up, "up ").otherwise("down "), F.format_string("%.1f", F.abs("WoW_Pct")), F.lit("% WoW"))
    slots = rows.select("table_id", "Rank", "Entity", text.alias("text"), F.when(drift, "drift").when(flip, "flip").otherwise("none").alias("planted"), F.col("Revenue_TW").alias("true_value"))
    notes = slots.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("Rank", "Entity", "text", "planted", "true_value"))).alias("x"))
    note = notes.select(F.concat(F.lit("note "), "table_id").alias("note_id"), "table_id", F.array_join(F.col("x.text"), "\n").alias("note"))
    out = notes.select(F.concat(F.lit("note "), "table_id").alias("note_id"), "table_id", F.posexplode("x").alias("line_idx", "s")).select("note_id", "table_id", "line_idx", "s.Entity", "s.text", "s.planted", "s.true_value")
    return note, out


def template_claims(notes_slots: DataFrame) -> DataFrame:
    """The revenue claim of each slot, as an extractor would give it."""
    return notes_slots.select(
        "note_id", "table_id", "line_idx", F.lit(0).alias("claim_idx"), F.col("Entity").alias("entity"), F.lit("revenue").alias("metric"), F.lit("TW").alias("period"), F.regexp_extract("text", r"(£[0-9,.]+\d)", 1).alias("value_text"),
        F.lit("none").alias("direction"), F.lit("none").alias("qualifier"),
    )
