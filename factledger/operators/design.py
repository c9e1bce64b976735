"""The design of a study: which tables are made and how long, what calls cost, which are already paid for, and where the
budget ends. Draws are by md5 of a seed and the row's key, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.evaluation import draw
from factledger.sources.scratch import stored


def table_plan(weekly: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``size``, ``week``, ``n_rows`` of the tables to make. ``plan`` has ``size``, ``least``, ``most``, ``tables``.

    The weeks of a size come in the order of a draw; each draws a number of rows, cut to the entities that traded, and
    weeks with fewer than ``least`` are passed over."""
    trading = weekly.where("revenue > 0").groupBy("week").agg(F.count(F.lit(1)).alias("trading"))
    both = trading.crossJoin(F.broadcast(plan)).where("trading >= least")  # a plan has a few rows
    drawn = F.col("least") + draw(F.col("most") - F.col("least") + 1, F.lit(seed), F.lit("rows"), F.col("size"), F.col("week"))
    order = Window.partitionBy("size").orderBy(F.md5(F.concat_ws("|", F.lit(seed), "size", "week")), "week")
    return both.withColumn("k", F.row_number().over(order)).where("k <= tables").select("size", "week", F.least(drawn, F.col("trading")).cast("long").alias("n_rows"))


def planned_rows(weekly: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of the planned tables: the first ``n_rows`` entities of the week by revenue."""
    ranked = weekly.where("revenue > 0").withColumn("pos", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("revenue"), "entity")))
    return plan.join(ranked, "week").where("pos <= n_rows").select("size", "week", "entity", "pos", "revenue")


def usable_reply(stop_reason: Column, had: Column, asked: Column) -> Column:
    """Whether a kept reply serves a request: one that was cut off at a lower limit than is asked for now does not."""
    return ~(F.coalesce(stop_reason.isin("max_tokens", "length"), F.lit(False)) & (asked > F.coalesce(had, F.lit(0))))


def cache_misses(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """The requests (``key``, ``max_tokens``) that no usable reply (``key``, ``stop_reason``, ``max_tokens``) serves, each key
    once with the greatest limit asked for."""
    asked = requests.groupBy("key").agg(F.max("max_tokens").alias("max_tokens"))
    had = replies.select("key", "stop_reason", F.col("max_tokens").alias("had"))
    return asked.join(had.where(F.col("key").isNotNull()), (asked["key"] == had["key"]) & usable_reply(had["stop_reason"], had["had"], asked["max_tokens"]), "left_anti")


def within_budget(calls: DataFrame, run: str, order: str, cost: str, cap: float) -> DataFrame:
    """The calls of each run that are made: one is made while what was spent before it is below the cap. Calls without cost cost
    nothing.

    A run's calls are summed range by range, each by itself, and what the run's ranges before have spent is added, so a run that
    holds most calls is no task of its own."""
    paid = calls.withColumn("__paid", F.coalesce(F.col(cost).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")))
    ranged = paid.repartitionByRange(run, order).withColumn("__range", F.spark_partition_id())
    placed = stored(ranged, "calls")
    sums = placed.groupBy(F.col(run).alias("__run"), F.col("__range").alias("__of")).agg(F.sum("__paid").alias("__spent"))  # a row for each run of a range
    earlier = Window.partitionBy("__run").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__run", "__of", F.coalesce(F.sum("__spent").over(earlier), F.lit(0)).alias("__before"))
    joined = placed.join(before, placed[run].eqNullSafe(before["__run"]) & (placed["__range"] == before["__of"]))
    own = F.sum("__paid").over(Window.partitionBy(run, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    spent = (F.coalesce(own, F.lit(0)) + F.col("__before")).cast("double")
    return joined.withColumn("spent_before", spent).where(F.col("spent_before") < cap).select(*calls.columns, "spent_before")


def estimated_cost(prompts: DataFrame, prices: DataFrame, by: str, repeats: int, chars: float = 3.0) -> DataFrame:
    """Tokens (characters / ``chars``) and cost of all prompts for each price. ``prompts`` has ``text`` and ``out`` (tokens
    of the answer), ``prices`` the column ``by``, ``price_in`` and ``price_out`` for a million."""
    each = prompts.groupBy(by).agg((F.sum(F.char_length("text")) / chars * repeats).alias("tokens_in"), (F.sum("out") * repeats).cast("double").alias("tokens_out"))
    return each.join(prices, by).select(by, "tokens_in", "tokens_out", (F.col("tokens_in") * F.col("price_in") / 1e6 + F.col("tokens_out") * F.col("price_out") / 1e6).alias("cost"))


def usable_facts(replies: DataFrame, key: str, text: str, most: int = 25) -> DataFrame:
    """``key``, ``k``, ``value`` of the facts in a script's output: a JSON list (or an object's ``facts``) of objects whose
    ``value`` is a finite number, the first ``most``. Anything else has none."""
    body = F.when(F.trim(text).startswith("{"), F.get_json_object(F.col(text), "$.facts")).otherwise(F.col(text))
    facts = F.from_json(F.when(F.trim(body).endswith("]"), body), "array<variant>")
    value = F.transform(facts, lambda x: F.try_variant_get(x, "$.value", "variant"))
    # Variants tell numbers from texts and truth values.
    numbers = F.filter(value, lambda v: F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"))
    finite = F.filter(F.transform(numbers, lambda v: F.try_variant_get(v, "$", "double")), lambda d: d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf")))
    return replies.select(key, F.posexplode(F.slice(finite, 1, most)).alias("k", "value"))
