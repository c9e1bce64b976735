"""Notes that are written, gated, repaired where numbers were flagged, and gated again.

A draft is slots: one row a number, with the true value, the value written and what was planted. Errors are drawn by md5: a
drift by one of four factors, the value of another row, or a turned sign; how many hangs on the strategy that writes. Each
round repairs a share of the flagged numbers, and only the lines that changed are read and gated again: the labels of all
other lines are carried over by key. What a round changes is stored as that round's delta, so the work of a round grows
with what it changes, and the loop ends where nothing is flagged or after the last round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators import gate
from factledger.operators.evaluation import wilson
from factledger.operators.mentions import mentions
from factledger.operators.names import LINE
from factledger.sources.scratch import stored

# Per cent of numbers that a strategy gets wrong, factors of a drift, shares of the kinds, per cent repaired.
WRONG = {"S1": 18, "S2": 7, "S4": 3}
FACTORS = [1.06, 0.92, 1.11, 0.95]
DRIFT, SWAP = 5, 3  # of 10 errors; the rest turn the sign
REPAIRED = 80
ROUNDS = 2
SLOT = [*LINE, "slot"]


def _draw(what: str, below: Column | int, *more: Column) -> Column:
    parts = [F.lit(what), "strategy", "table_id", "Entity", F.col("slot").cast("string"), *more]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long"), below if isinstance(below, Column) else F.lit(below))


def drafts(tables: DataFrame, strategies: dict[str, int] | None = None, top: int = 3) -> DataFrame:
    """``note_id``, ``table_id``, ``line_idx``, ``slot``, ``strategy``, ``Entity``, ``truth``, ``value``, ``planted``: revenue and change
    of the first rows of each table, as each strategy writes them."""
    strategies = WRONG if strategies is None else strategies
    cells = F.array(F.struct(F.lit(0).alias("slot"), F.col("Revenue_TW").cast("double").alias("truth")), F.struct(F.lit(1).alias("slot"), F.col("WoW_Pct").cast("double").alias("truth")))
    every = tables.select("table_id", "Rank", "Entity", "WoW_Pct", F.explode(cells).alias("x")).select("table_id", "Rank", "Entity", "WoW_Pct", "x.*").where("truth is not null")
    column = Window.partitionBy("table_id", "slot")
    every = every.withColumns({"k": F.row_number().over(column.orderBy("Rank", "Entity")) - 1, "n": F.count(F.lit(1)).over(column)})
    written = every.where((F.col("Rank") <= top) & F.col("WoW_Pct").isNotNull()).withColumn("line_idx", F.row_number().over(column.orderBy("Rank", "Entity")) - 1)
    how = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(rate).alias("rate")) for s, rate in strategies.items()])).alias("h")
    slots = written.select("*", how).select(*written.columns, "h.*")
    kind = _draw("kind", 10)
    planted = (
        F.when(_draw("wrong", 100) >= F.col("rate"), "none").when((kind >= DRIFT) & (kind < DRIFT + SWAP) & (F.col("n") > 1), "swap")
        .when((kind >= DRIFT + SWAP) & (F.col("slot") == 1), "flip").otherwise("drift")
    )
    pick = F.when(F.col("n") > 1, _draw("swap", F.greatest(F.col("n") - 1, F.lit(1))))
    slots = slots.withColumns({"planted": planted, "factor": F.get(F.array(*map(F.lit, FACTORS)), _draw("factor", len(FACTORS)).cast("int")), "other": pick + (pick >= F.col("k")).cast("int")})
    others = every.select("table_id", "slot", F.col("k").alias("other"), F.col("truth").alias("swapped"))
    value = F.when(F.col("planted") == "drift", F.col("truth") * F.col("factor")).when(F.col("planted") == "swap", F.col("swapped")).when(F.col("planted") == "flip", -F.col("truth")).otherwise(F.col("truth"))
    joined = slots.join(others, ["table_id", "slot", "other"], "left")
    return joined.select(F.concat("strategy", F.lit(" "), "table_id").alias("note_id"), "table_id", "line_idx", "slot", "strategy", "Entity", "truth", value.alias("value"), "planted")


def lines_of(slots: DataFrame) -> DataFrame:
    """``note_id``, ``table_id``, ``line_idx``, ``line`` of the slots' lines."""
    money = F.concat(F.lit("£"), F.format_number(F.rint(F.col("value") * 100) / 100, 2))
    change = F.concat(F.when(F.col("value") >= 0, "up ").otherwise("down "), F.format_string("%.1f", F.rint(F.abs("value") * 10) / 10), F.lit("%"))
    said = slots.groupBy(*LINE, "table_id", "Entity").agg(*[F.max(F.when(F.col("slot") == k, x)).alias(f"s{k}") for k, x in enumerate((money, change))])
    return said.select(*LINE, "table_id", F.concat(F.lit("- "), "Entity", F.lit(" revenue was "), "s0", F.lit(" TW, "), "s1", F.lit(" WoW")).alias("line"))


def regated(before: DataFrame, changed: DataFrame, tables: DataFrame) -> DataFrame:
    """The labels of level 1 after the lines ``changed`` have been written anew: those are gated, all others keep the labels
    that they had ``before``. A line's labels hang on that line and its table alone."""
    again = gate.level1(mentions(changed), changed, tables.join(changed.select("table_id").distinct(), "table_id", "left_semi"))
    return before.join(changed.select(*LINE).distinct(), LINE, "left_anti").unionByName(again.select(*before.columns))


def substituted(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The slots with the true values in place of what was planted, and the lines that this changes."""
    right = slots.withColumn("value", F.col("truth"))
    touched = slots.where("planted <> 'none'").select(*LINE).distinct()
    return right, lines_of(right.join(touched, LINE, "left_semi"))


LABELS = ["note_id", "line_idx", "mention_idx", "table_id", "raw_text", "label"]


def gated(slots: DataFrame, tables: DataFrame) -> DataFrame:
    lines = stored(lines_of(slots), "lines")
    return stored(gate.level1(mentions(lines), lines, tables).select(*LABELS), "labels")


def verified(slots: DataFrame, tables: DataFrame, rounds: int = ROUNDS, repaired: int = REPAIRED) -> list[DataFrame]:
    """The labels after each round, the draft's first. A flagged number is repaired with a chance of ``repaired`` per cent;
    the numbers of a line stand in the order of its slots."""
    now, labels = slots, [gated(slots, tables)]
    for r in range(1, rounds + 1):
        flagged = labels[-1].where("label = 'Unsupported'").select(*LINE, F.col("mention_idx").alias("slot"))
        fixed = now.join(flagged, SLOT, "left_semi").where(_draw("repair", 100, F.lit(str(r))) < repaired)
        delta = stored(fixed.withColumn("value", F.col("truth")), "delta")
        if delta.isEmpty():
            break
        now = stored(now.join(delta.select(*SLOT), SLOT, "left_anti").unionByName(delta.select(*now.columns)), "slots")
        changed = stored(lines_of(now.join(delta.select(*LINE).distinct(), LINE, "left_semi")), "changed")
        labels.append(stored(regated(labels[-1], changed, tables), "labels"))
    return labels


def round_rates(labels: list[DataFrame]) -> DataFrame:
    """``round``, ``strategy``, ``n_checked``, ``n_unsupported`` and the rate; a round that changed nothing is not there."""
    every = [x.select(F.lit(r).alias("round"), F.split("note_id", " ")[0].alias("strategy"), "label") for r, x in enumerate(labels)]
    rows = every[0]
    for x in every[1:]:
        rows = rows.unionByName(x)
    checked, bad = F.count_if(F.col("label") != "Skipped"), F.count_if(F.col("label") == "Unsupported")
    return rows.groupBy("round", "strategy").agg(checked.alias("n_checked"), bad.alias("n_unsupported"), F.when(checked > 0, bad / checked).alias("unsupported_rate"))


INJECTED = 60  # per cent of the numbers of a copy that get an error


def injected(tables: DataFrame, copies: int, rate: int = INJECTED) -> DataFrame:
    """Slots of many copies of each table's note, errors drawn anew in each: copy k is that of strategy ``Mk``."""
    return drafts(tables, {f"M{k}": rate for k in range(copies)})


def detection(slots: DataFrame, labels: DataFrame) -> DataFrame:
    """``planted``, ``n``, ``flagged``, ``rate`` and its Wilson interval over all copies: how many errors of each kind the gate
    flags, and, for ``none``, how many right numbers. An error that the rounding hides, or that gives a value the table has elsewhere, is
    not flagged; a number that level 1 skips counts as not flagged."""
    flagged = (F.col("label") == "Unsupported").cast("long")
    judged = labels.select(*LINE, F.col("mention_idx").alias("slot"), flagged.alias("flagged"))
    each = slots.select(*SLOT, "planted").join(judged, SLOT, "left")
    found = each.groupBy("planted").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged"))
    low, high = wilson(F.col("flagged"), F.col("n"))
    low, high = F.when(F.col("flagged") == 0, 0.0).otherwise(low), F.when(F.col("flagged") == F.col("n"), 1.0).otherwise(high)
    return found.select("planted", "n", "flagged", (F.col("flagged") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))
