"""Claims and the numbers that they stand for, against the rule in plain Python, and the shuffles of the plan."""

import random
import re

from pyspark.sql import functions as F

from factledger.operators import evaluation, outcomes

NUMBERS = "note_id string, line_idx int, position long, raw_text string, gone boolean"
CLAIMS = "note_id string, line_idx int, claim_idx int, value_text string"


def expected(numbers, claims):
    out, turn = [], {}
    key = lambda look, text: (look, text if look == "t" else re.sub("[^0-9.]", "", text))
    for note, line, idx, text in sorted((c for c in claims if c[0] is not None and c[3] is not None), key=lambda c: (c[0], c[1], c[2])):
        own = [n for n in numbers if n[:2] == (note, line) and n[3] is not None]
        look = "t" if any(n[3] == text for n in own) else "d"
        want = key(look, text)
        same = sorted((n[2], n[4]) for n in own if key(look, n[3]) == want)
        if not same or want == ("d", ""):
            continue
        k = turn[note, line, want] = turn.get((note, line, want), -1) + 1
        free = [at for at, gone in same if gone is False]
        out.append((note, line, idx, free[k] if k < len(free) else same[0][0]))
    return sorted(out)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_claims_meet_numbers_in_one_shuffle(spark):
    rng = random.Random(5)
    texts = ["1", "£1", "1%", "2", "£2", "x", "y", "", "12", "£12", None]
    numbers = [(rng.choice(["a", "b", None]), rng.randrange(6), 10 * i, rng.choice(texts), rng.choice([True, False, None])) for i in range(300)]
    claims = [(rng.choice(["a", "b", None]), rng.randrange(7), i, rng.choice([*texts, "3"])) for i in range(200)]
    found = outcomes.claim_numbers(spark.createDataFrame(numbers, NUMBERS), spark.createDataFrame(claims, CLAIMS), F.col("gone"))
    assert plan(found).count("Exchange hashpartitioning") == 1 and "Join" not in plan(found)
    want = expected(numbers, claims)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 80


def test_repeats_in_one_aggregation(spark):
    rows = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (1, 2, 7.0), (2, 1, 5.0), (3, 1, None), (3, 2, 1.0), (None, 1, 2.0), (None, 2, 3.0), (4, 3, 1.0)], "k int, at int, value double")
    wide = evaluation.side_by_side(rows, ["k"], "at", "value", {1: "first", 2: "second"})
    assert sorted(map(tuple, wide.collect()), key=str) == [(1, 5.0, 7.0), (None, 2.0, 3.0)]
    assert "pivotfirst" not in plan(wide).lower()
