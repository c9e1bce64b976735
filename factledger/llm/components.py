"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import discard, stored


def _least(edges: DataFrame) -> DataFrame:
    """For each first end, the least node next to it or itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return down.join(_least(down), "u").select("m", F.explode(F.array("u", "v")).alias("u")).where("u <> m").select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (least node reachable) of every node of the links ``u``, ``v`` (two longs).

    Links to oneself, repeats and either direction are fine; an empty table gives an empty one. Every round is written
    to the shared folder; the driver sees only a count and a checksum of it."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen.n, seen.x) == mark or not seen.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark, last = (seen.n, seen.x), now
        now = stored(_small_star(_large_star(now)), "links")
        discard(last)
