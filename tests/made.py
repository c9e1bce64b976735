"""Report tables made by a seeded generator, and how their numbers are written in notes. What is true of a line is known from
the row that it is written from, so labels need no list of cases."""

import random

from pyspark.sql import functions as F

NAMES = {
    "markets": ["Vellan", "Orrin Bay", "Tal Isle", "Brask", "East Quay", "Port Sable", "Nimmerholt", "Upper Cray", "Dunmarrow"],
    "goods": ["COPPER KETTLE SMALL", "COPPER KETTLE LARGE", "OAK SHELF 3 TIER", "LINEN APRON 60'S STRIPE", "FELT SLIPPER PAIR", "BRASS HOOK SET", "WAX CANDLE TALL"],
    "lamps": ["HARBOUR LAMP IVORY", "HARBOUR LAMP OCHRE", "HARBOUR LAMP SLATE", "HARBOUR LAMP TEAL", "MEADOW RUG NARROW", "MEADOW RUG WIDE"],
    "aliased": ["United Kingdom", "Italy", "Spain", "Sweden", "Portugal"],
}
LEVELS = "table_id string, Entity string, Revenue_TW double, Revenue_LW double, Revenue_LY double, Units_TW long, Units_LW long, Orders_TW long, Orders_LW long"


def rows(seed=20):
    """The level columns. A number may be 0 or missing a year ago; the first table has a row that is new this week."""
    rng, out = random.Random(seed), []
    for table, names in NAMES.items():
        for k, name in enumerate(names):
            money = lambda: round(rng.uniform(3_000, 97_000), 2)  # noqa: B023, E731
            new = table == "markets" and k == 3
            out.append((table, name, money(), 0.0 if new else money(), rng.choice([None, 0.0, money(), money()]), rng.randint(400, 9_999), 0 if new else rng.randint(400, 9_999), rng.randint(101, 399), 0 if new else rng.randint(101, 399)))
    return out


def tables(spark):
    t = spark.createDataFrame(rows(), LEVELS)
    change = lambda a, b: F.when(F.col(b) > 0, F.rint((F.col(a) - F.col(b)) / F.col(b) * 1000) / 10)
    return t.select(
        "*", change("Revenue_TW", "Revenue_LW").alias("WoW_Pct"), change("Revenue_TW", "Revenue_LY").alias("YoY_Pct"), F.expr("rint(Revenue_TW / sum(Revenue_TW) over (partition by table_id) * 1000) / 10 as Share_Pct"),
        F.expr("cast(rank() over (partition by table_id order by Revenue_TW desc) as long) as Rank"),
    )


def money(x):
    return f"£{x:,.2f}"


def ordinal(n):
    return f"{n}{ {1: 'st', 2: 'nd', 3: 'rd'}.get(n, 'th') }"


def change(x):
    return f"{'up' if x >= 0 else 'down'} {abs(x):.1f}%"
