"""Rates, resampling, tests and samples over verdicts. Resampling draws by md5, so any engine can repeat it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factledger.operators.replicates import binomial_sums, replicate_sums
from factledger.sources.scratch import stored


def draw(n: Column, *parts: Column) -> Column:
    """A repeatable index below n from the parts: the first 15 hex digits of their md5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long"), n)


def rates_by_sets(verdicts: DataFrame, sets: list[list[str]], num: str, den: str) -> DataFrame:
    """Pooled ratio for each grouping set; zero denominators give null. One pass with GROUPING SETS."""
    columns = sorted({c for s in sets for c in s})
    pooled = (F.sum(num).cast("double") / F.expr(f"nullif(sum({den}), 0)")).alias("rate")
    return verdicts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"), pooled)


def uniform(*parts: Column) -> Column:
    """A repeatable number from 0 to below 1."""
    return draw(F.lit(1 << 40), *parts) / (1 << 40)


def numbered(rows: DataFrame, keys: list[str], name: str = "at") -> DataFrame:
    """The rows numbered from 1 by the keys: each range of keys by itself, and then after the ranges before it."""
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(ranged.select("*", F.spark_partition_id().alias("__part"), (F.monotonically_increasing_id() % F.lit(1 << 33) + 1).alias("__k")), "numbered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__k")).drop("__part", "__k", "__before")


def bootstrap_many(units: DataFrame, rates: dict[str, tuple[str, str]], key: str, rounds: int, *salt: Column) -> DataFrame:
    """``b`` and each rate, sum(num) / sum(den), of the units that a round draws with replacement; null where nothing is in
    the denominator. One pass over the units (``replicates``)."""
    values = {f"{part}_{k}": F.col(c) for k, pair in enumerate(rates.values()) for part, c in zip(("num", "den"), pair, strict=True)}
    sums = replicate_sums(units, values, rounds, *salt, F.col(key))
    return sums.select("b", *[F.expr(f"num_{k} / nullif(den_{k}, 0)").alias(name) for k, name in enumerate(rates)])


def intervals(rounds: DataFrame, names: list[str]) -> DataFrame:
    """``rate``, ``rounds``, ``low``, ``high``: the percentile interval of each column."""
    ends = rounds.agg(*[F.struct(F.lit(x).alias("rate"), F.count(x).alias("rounds"), F.percentile(x, F.array(F.lit(0.025), F.lit(0.975))).alias("p")).alias(x) for x in names])
    return ends.select(F.explode(F.array(*names)).alias("x")).select("x.rate", "x.rounds", F.col("x.p")[0].alias("low"), F.col("x.p")[1].alias("high"))


def bootstrap(units: DataFrame, num: str, den: str, key: str, rounds: int) -> DataFrame:
    """Percentile interval of sum(num) / sum(den) over units drawn with replacement."""
    return intervals(bootstrap_many(units, {"rate": (num, den)}, key, rounds), ["rate"]).drop("rate")


def padded(rows: DataFrame, unit: str, at: str, value: str, last: int) -> DataFrame:
    """A row for each unit and round from its first to ``last``, where a unit that has ended keeps its last value."""
    every = rows.groupBy(unit).agg(F.min(at).alias("least"), F.max(at).alias("own_last"), F.max_by(value, at).alias("final"))
    slots = every.where(f"own_last < {last}").select(unit, F.explode(F.sequence(F.col("own_last") + 1, F.lit(last).cast("long"))).alias(at), F.col("final").alias(value))
    return rows.select(unit, F.col(at).cast("long").alias(at), value).unionByName(slots)


def bootstrap_means(rows: DataFrame, at: str, unit: str, value: str, rounds: int) -> DataFrame:
    """For each ``at``: the mean of ``value`` over its units, their number and the mean's percentile interval. Every unit has a
    row for each ``at``; the draws of each are its own."""
    known = rows.select(F.col(at).alias("at"), F.col(unit).alias("unit"), F.col(value).cast("double").alias("value"))
    sums = replicate_sums(known, {"value": F.col("value"), "n": F.col("value").isNotNull().cast("int")}, rounds, F.col("at"), F.col("unit"), by="at")
    ends = sums.groupBy("at").agg(F.percentile(F.expr("value / nullif(n, 0)"), F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    mean = (F.sum(F.col("value").cast("decimal(28,12)")).cast("double") / F.count(F.lit(1))).alias("mean")
    whole = known.groupBy("at").agg(mean, F.count(F.lit(1)).alias("n"))
    return whole.join(ends, "at").select(F.col("at").alias(at), "n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def difference_of_sets(first: DataFrame, second: DataFrame, num: str, den: str, key: str, rounds: int) -> DataFrame:
    """Bootstrap of the difference of pooled rates (second minus first) of two sets of units, each drawn by itself."""
    one, two = (bootstrap_many(x, {name: (num, den)}, key, rounds, F.lit(name)) for x, name in ((first, "first"), (second, "second")))
    gap = one.join(two, "b").select((F.col("second") - F.col("first")).alias("d")).where("d is not null")
    whole = lambda x, name: x.agg((F.sum(num) / F.expr(f"nullif(sum({den}), 0)")).alias(name))
    return _with_ends(whole(first, "one").crossJoin(whole(second, "two")).select((F.col("two") - F.col("one")).alias("difference")), gap)


def _with_ends(whole: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row with the interval of the gaps ``d`` and their two-sided p."""
    both = F.least(F.avg((F.col("d") <= 0).cast("int")), F.avg((F.col("d") >= 0).cast("int")))
    found = gaps.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("p"), F.least(F.lit(1.0), 2 * both).alias("p_value"))
    return whole.crossJoin(F.broadcast(found)).select(*whole.columns, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "p_value")


def conditional_test(rows: DataFrame, keys: list[str], arm: str, a: str, b: str, rounds: int) -> DataFrame:
    """Test of rate(b) - rate(a) over units that both arms have, given each unit's events: under equal rates an event is one of
    arm b with the chance of b's share of the unit's trials, so their number is binomial, and each round draws it once a unit.
    With it the sign test over units: ``difference``, ``p``, ``units_with_events``, ``up``, ``down``, ``sign_p``."""
    side = lambda name, x: rows.where(F.col(arm) == name).select(*keys, F.col("num").cast("long").alias(f"num_{x}"), F.col("den").cast("long").alias(f"den_{x}"))
    unit = stored(side(a, "a").join(side(b, "b"), keys).withColumn("__events", F.col("num_a") + F.col("num_b")), "pairs")
    rate = lambda x: F.col(f"num_{x}") / F.greatest(f"den_{x}", F.lit(1))
    whole = unit.agg(
        (F.sum("num_b") / F.sum("den_b") - F.sum("num_a") / F.sum("den_a")).alias("difference"), F.sum("den_a").alias("da"), F.sum("den_b").alias("db"), F.sum("__events").alias("events"), F.count_if(F.col("__events") > 0).alias("units_with_events"),
        F.count_if(rate("b") > rate("a")).alias("up"), F.count_if(rate("b") < rate("a")).alias("down"),
    )
    chance = F.expr("den_b / nullif(den_a + den_b, 0)")
    sims = binomial_sums(unit.withColumn("__chance", chance), "__events", "__chance", rounds, *map(F.col, keys)).select(F.col("total").alias("sim_b"))
    far = sims.crossJoin(F.broadcast(whole)).where("abs(sim_b / db - (events - sim_b) / da) >= abs(difference) - 1e-12").agg(F.count(F.lit(1)).alias("far"))
    # Without an event every round gives a difference of nothing, which is as far as what was seen.
    out = whole.crossJoin(F.broadcast(far)).withColumn("far", F.when(F.col("events") == 0, rounds).otherwise(F.col("far")))
    n = F.col("up") + F.col("down")
    sign = F.when(n > 0, F.least(F.lit(1.0), 2 * binomial_cdf(F.least("up", "down"), n, F.lit(0.5))))
    return out.select("difference", ((F.col("far") + 1) / (rounds + 1)).alias("p"), "units_with_events", "up", "down", sign.alias("sign_p"))


def recall_bound(found: Column, sampled: Column, wrong: Column, unflagged: Column) -> dict[str, Column]:
    """The most errors that a gate can have missed, by the exact upper end of the share of wrong ones in a sample of what it
    did not flag, and the least share of all errors that the ``found`` ones are."""
    most = clopper_pearson(wrong, sampled)[1] * unflagged
    return {"max_missed": most, "recall_lower": F.when(found + most > 0, found / (found + most))}


def expected_precision(base: Column, false_alarms: Column, recall: Column) -> Column:
    """Share of right flags, by the base rate of errors, the share of right numbers flagged, and that of wrong ones."""
    return recall * base / F.nullif(recall * base + false_alarms * (1 - base), F.lit(0.0))


def summary(notes: DataFrame, by: list[str]) -> DataFrame:
    """Notes, failures, pooled rates and mean cost and time of each group."""
    pooled = lambda a, b: F.expr(f"sum({a}) / nullif(sum({b}), 0)")
    mean = lambda c: F.sum(F.col(c).cast("decimal(24,6)")).cast("double") / F.count(c)
    return notes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_notes"), F.count_if("failed").alias("n_failed"), pooled("n_unsupported", "n_checked").alias("unsupported_rate"), pooled("n_wrong", "n_verifiable").alias("claim_error_rate"),
        mean("cost").alias("mean_cost"), mean("latency").alias("mean_latency"),
    )


def holm(tests: DataFrame, p: str = "p", name: str = "name") -> DataFrame:
    """Step-down adjusted p: the running greatest of (m - rank) p, one at most. Ranges of p are gone through each by itself,
    and what the ranges before it have reached is added."""
    ranked = numbered(tests, [p, name], "rn")
    m = ranked.count()
    step = ranked.select(name, p, "rn", F.least(F.lit(1.0), (m - F.col("rn") + 1) * F.col(p)).alias("step"), F.expr("(rn - 1) div 4096").alias("range"))
    tops = step.groupBy("range").agg(F.max("step").alias("top"))  # one row for 4,096 tests
    before = tops.select("range", F.max("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    running = F.max("step").over(Window.partitionBy("range").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("running", running).join(F.broadcast(before), "range").select(name, p, F.greatest("running", F.coalesce("before", F.lit(0.0))).alias("p_holm"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two binary columns."""
    m = pairs.agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("agree"), F.avg(F.col(a)).alias("pa"), F.avg(F.col(b)).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select("agree", F.when(chance < 1, (F.col("agree") - chance) / (1 - chance)).alias("kappa"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a proportion."""
    p = k / n
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return mid - half, mid + half


def by_draw(seed: str, key: str) -> list[Column]:
    """An order that a seed and the key settle."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def stratified(rows: DataFrame, strata: list[str], key: str, size: int, seed: str) -> DataFrame:
    """The first ``size`` rows of each stratum in the order of an md5 of the seed and the key."""
    return rows.withColumn("pick", F.row_number().over(Window.partitionBy(*strata).orderBy(*by_draw(seed, key)))).where(F.col("pick") <= size)


def audit_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """About n rows spread evenly over the strata, topped up from the rest where strata are small, n at most.

    Of a stratum and of the rest only the first n by draw can matter, so no more is ordered together."""
    ranked = stratified(rows, strata, key, n, seed)
    cell = max(1, n // max(1, rows.select(*strata).distinct().count()))
    return ranked.withColumn("extra", (F.col("pick") > cell).cast("int")).orderBy("extra", *by_draw(seed, key)).limit(n).drop("pick")


def precision_recall(rows: DataFrame, truth: str, found: str) -> DataFrame:
    """Precision and recall of each label of two columns."""
    label = rows.select(F.explode(F.array_distinct(F.array(truth, found))).alias("label"), truth, found)
    hit = F.sum(((F.col(truth) == F.col("label")) & (F.col(found) == F.col("label"))).cast("long"))
    n_found, n_true = (F.sum((F.col(c) == F.col("label")).cast("long")) for c in (found, truth))
    return label.groupBy("label").agg(hit.alias("tp"), n_found.alias("n_found"), n_true.alias("n_true")).select("*", F.expr("tp / nullif(n_found, 0)").alias("precision"), F.expr("tp / nullif(n_true, 0)").alias("recall"))


def paired_difference(rows: DataFrame, keys: list[str], arm: str, a: str, b: str, rounds: int) -> DataFrame:
    """Bootstrap of rate(a) - rate(b) over units that both arms have: ``n``, ``difference``, ``low``, ``high`` and a
    two-sided p."""
    side = lambda name, x: rows.where(F.col(arm) == name).select(*keys, F.col("num").alias(f"num_{x}"), F.col("den").alias(f"den_{x}"))
    unit = side(a, "a").join(side(b, "b"), keys)
    parts = {x: F.col(x) for x in ("num_a", "den_a", "num_b", "den_b")}
    each = replicate_sums(unit, parts, rounds, *map(F.col, keys)).select(F.expr("num_a / nullif(den_a, 0) - num_b / nullif(den_b, 0)").alias("d"))
    gap = F.expr("sum(num_a) / nullif(sum(den_a), 0) - sum(num_b) / nullif(sum(den_b), 0)")
    return _with_ends(unit.agg(F.count(F.lit(1)).alias("n"), gap.alias("difference")), each.where("d is not null"))


def consensus(first: DataFrame, second: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """Two reviewers' verdicts where they agree, else the third's; null and ``open`` where that one is missing."""
    j = first.select(key, F.col("verdict").alias("a")).join(second.select(key, F.col("verdict").alias("b")), key).join(third.select(key, F.col("verdict").alias("c")), key, "left")
    final = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("c"))
    return j.select(key, final.alias("final"), (F.col("a") == F.col("b")).alias("agree"), final.isNull().alias("open"))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) of a binomial, by the recurrence of its terms in logarithms; 1 for k >= n, 0 for k < 0."""
    start = F.struct((n * F.log1p(-p)).alias("term"), F.exp(n * F.log1p(-p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * p / (1 - p))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    total = F.when(k < 1, start["sum"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), start, step)["sum"])
    return F.when(k < 0, 0.0).when((k >= n) | (p <= 0), 1.0).when(p >= 1, 0.0).otherwise(F.least(total, F.lit(1.0)))


def clopper_pearson(k: Column, n: Column, level: float = 0.95, steps: int = 60) -> tuple[Column, Column]:
    """Exact interval of a proportion, each end by bisection of the binomial distribution."""
    tail = (1 - level) / 2

    def end(beyond) -> Column:
        def step(acc: Column, _: Column) -> Column:
            mid = (acc["a"] + acc["b"]) / 2
            right = beyond(mid)
            return F.struct(F.when(right, mid).otherwise(acc["a"]).alias("a"), F.when(right, acc["b"]).otherwise(mid).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), step)["a"]

    low = F.when(k <= 0, 0.0).otherwise(end(lambda p: 1 - binomial_cdf(k - 1, n, p) < tail))
    high = F.when(k >= n, 1.0).otherwise(end(lambda p: binomial_cdf(k, n, p) > tail))
    return low, high


def carried_forward(rows: DataFrame, unit: str, at: str, value: str) -> DataFrame:
    """Mean ``value`` of all units in each round (``at``, 1 and on, without gaps in a unit), where a unit that has ended
    keeps its last value. Sums of rounds and of ended units meet, so no unit is padded row by row."""
    ended = rows.groupBy(unit).agg(F.max(at).alias("last"), F.max_by(value, at).alias("final")).groupBy("last").agg(F.sum("final").alias("final"), F.count(F.lit(1)).alias("gone"))
    each = rows.groupBy(at).agg(F.sum(value).alias("own"), F.count(F.lit(1)).alias("alive")).join(ended, F.col(at) == F.col("last"), "left")
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)  # one row a round
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    n = F.col("alive") + past("gone")
    return each.select(F.col(at).cast("long").alias("round"), n.alias("n"), ((F.col("own") + past("final")).cast("double") / n).alias("mean"))


def side_by_side(rows: DataFrame, keys: list[str], repeat: str, value: str, names: dict[int, str]) -> DataFrame:
    """The values of the repeats in columns of their own; keys that lack one are left out."""
    wide = rows.where(F.col(repeat).isin(list(names))).groupBy(*keys).agg(*[F.max(F.when(F.col(repeat) == k, F.col(value))).alias(x) for k, x in names.items()])
    return wide.dropna(subset=list(names.values()))


def quotas(groups: DataFrame, group: str, total: int) -> DataFrame:
    """``total`` split over the groups (a few, one row each), the first ones by name taking what is over."""
    k, m = F.row_number().over(Window.orderBy(group)), F.count(F.lit(1)).over(Window.partitionBy())
    return groups.select(group).distinct().select(group, (F.floor(F.lit(total) / m) + (k <= F.lit(total) % m).cast("long")).cast("long").alias("quota"))


def review_batches(rows: DataFrame, strata: list[str], key: str, quota: int, size: int, seed: str) -> DataFrame:
    """A quota of each stratum in batches of ``size``. ``item_id`` is what a reviewer sees; the rest is the key to it."""
    item = F.md5(F.concat(F.lit(f"{seed}|item|"), F.col(key).cast("string")))
    return stratified(rows, strata, key, quota, seed).select(*strata, key, item.alias("item_id"), F.floor((F.col("pick") - 1) / size).cast("long").alias("batch"))


def review_items(rows: DataFrame, group: str, key: str, total: int, size: int, seed: str) -> DataFrame:
    """Items for blind review: ``total`` split over the groups, all put in one order by draw, numbered and cut into batches of
    ``size``: ``item_id`` (it0001 and on), ``batch`` and the row."""
    ranked = rows.withColumn("pick", F.row_number().over(Window.partitionBy(group).orderBy(*by_draw(seed, key)))).where(F.col("pick") <= total)
    chosen = ranked.join(F.broadcast(quotas(rows, group, total)), group).where("pick <= quota").drop("pick", "quota")
    shuffled = numbered(chosen.withColumn("__order", F.md5(F.concat(F.lit(f"{seed}|all|"), F.col(key).cast("string")))), ["__order", key], "item").drop("__order")
    return shuffled.withColumn("item_id", F.format_string("it%04d", "item")).withColumn("batch", F.expr(f"(item - 1) div {size} + 1"))


def blind(items: DataFrame, shown: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """What a reviewer sees, and the key to it kept apart; they share ``item_id`` alone."""
    return items.select("item_id", "batch", *shown), items.select("item_id", key, *[c for c in items.columns if c not in ("item_id", "batch", "item", key, *shown)])


def binary_precision_recall(rows: DataFrame, truth: str, found: str, errors: list[str]) -> DataFrame:
    """Precision and recall of ERROR and OK, as the labels of both columns come to."""
    two = lambda c: F.when(F.col(c).isin(errors), "ERROR").otherwise("OK")
    return precision_recall(rows.select(two(truth).alias("t"), two(found).alias("f")), "t", "f")


def missing(keys: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """The items of a key that nobody has judged."""
    return keys.select(key).join(verdicts.select(key), key, "left_anti")
