"""Ratios against plain ones, written out with the textbook table of common subsequences."""

import random

from pyspark.sql import functions as F

from factledger.functions import likeness


def lcs(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        last, row = row, [0]
        for i, x in enumerate(a):
            row.append(last[i] + 1 if x == y else max(row[-1], last[i + 1]))
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    if not b:
        return 100.0
    if not a:
        return 0.0
    return max(ratio(a, b[max(0, s) : s + len(a)]) for s in range(1 - len(a), len(b)))


def sort(a, b):
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a, b):
    wa, wb = sorted(set(a.split())), sorted(set(b.split()))
    if not wa or not wb:
        return 0.0
    both = [w for w in wa if w in wb]
    ra, rb = [w for w in wa if w not in wb], [w for w in wb if w not in wa]
    if both and (not ra or not rb):
        return 100.0
    left, right, shared = " ".join(both + ra), " ".join(both + rb), " ".join(both)
    return max(ratio(left, right), ratio(shared, left) if both else 0, ratio(shared, right) if both else 0)


def weighted(a, b):
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    if unlike < 1.5:
        return max(ratio(a, b), 0.95 * max(sort(a, b), token_set(a, b)))
    scale = 0.9 if unlike <= 8 else 0.6
    token = 100.0 if set(a.split()) & set(b.split()) else partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * token)


def pairs():
    rng = random.Random(3)
    words = "red blue woven picnic basket glass jar of the set mat lantern black".split()
    out = [("", ""), ("", "a"), ("a", "a"), ("abc", "xyz"), ("welcome mat", "the welcome mats are here"), ("x" * 70, "x" * 65 + "y"), ("ab" * 100, "ba" * 90), (" ", "a b"), ("ñandú", "nandú é")]
    for _ in range(60):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))
        b = list(a if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 14))))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], ["q"], [b[k], "z"], [" "]])
        out.append((a, "".join(b)))
    out += [(b, a) for a, b in out[:30]]
    long = "".join(rng.choice("abcd ") for _ in range(140))
    return out + [(long, long[20:110]), (long, long[::-1])]


def test_ratios(spark):
    rows = pairs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string").repartition(8)
    forms = {"ratio": likeness.ratio, "partial": likeness.partial_ratio, "sort": likeness.token_sort_ratio, "token_set": likeness.token_set_ratio, "weighted": likeness.weighted_ratio}
    plain = {"ratio": ratio, "partial": partial, "sort": sort, "token_set": token_set, "weighted": weighted}
    for name, form in forms.items():
        for r in df.select("i", form(F.col("a"), F.col("b")).alias("x")).collect():
            a, b = rows[r.i]
            assert abs(r.x - plain[name](a, b)) < 1e-9, (name, a, b, r.x, plain[name](a, b))
