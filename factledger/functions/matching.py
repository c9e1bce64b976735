"""Rounding-aware comparison of a cited number with a true one, and the units that may meet. Column functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GUARD = 1e-9


def matches(true: Column, cited: Column, decimals: Column, scale: Column, qualifier: Column, signed: Column, bounds: Column, rounding: Column | float = 1.0, scaled_by: Column | float = 0.005, about_by: Column | float = 0.05, hedged: Column | bool = True) -> Column:
    """Whether the true value rounds half-up to the cited one at its precision, on magnitudes.

    Scaled citations (k, M, B) also match within half a percent, "about" within five percent; "over" and "under" are
    bounds up to one and a half times away where bounds are allowed. A signed citation must agree in sign. The tolerances,
    how many halves of the last place a rounding may be off, and whether hedges count, may be columns of a rule."""
    size, target = F.abs(true), F.abs(cited) * scale
    half = F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * rounding
    gap = size / scale - F.abs(cited)
    rounds = (gap >= -half - GUARD) & (gap < half - GUARD)
    scaled = (scale > 1) & (F.abs(size - target) <= scaled_by * size)
    hedged = F.lit(hedged) if isinstance(hedged, bool) else hedged
    about = (qualifier == "approx") & (F.abs(size - target) <= about_by * size)
    over = (qualifier == "over") & (size >= target - half * scale) & (size <= 1.5 * target)
    under = (qualifier == "under") & (size <= target + half * scale) & (size >= target / 1.5) & (size > 0)
    sign = ~signed | (F.signum(true) == F.signum(cited)) | (true == 0) | (cited == 0)
    return F.coalesce((rounds | scaled | hedged & (about | (bounds & (over | under)))) & sign, F.lit(False))


def unit_ok(candidate: Column, unit: Column, is_rank: Column, is_ratio: Column, strict_plain: bool = False) -> Column:
    """Ranks meet only ranks and ratios only ratios; a plain number meets all else, ratios too unless ``strict_plain``."""
    plain = (candidate != "ratio") if strict_plain else F.lit(True)
    return F.when(is_rank, candidate == "rank").when(is_ratio, candidate == "ratio").when(candidate == "rank", False).when(unit == "plain", plain).otherwise(candidate == unit)


# A grid on magnitudes: values that a citation may mean lie in few of its cells, so that citations meet values in an equi-join.
LEAST, STEP = 1e-3, 1.02
CLASSES = ["currency", "count", "percent", "ratio"]


def cell(size: Column) -> Column:
    """The cell of a magnitude: 0 below ``LEAST``, then one for each ``STEP`` times."""
    return F.when(size < LEAST, 0).otherwise(F.floor(F.log(size / LEAST) / math.log(STEP)) + 1).cast("int")


def reach(cited: Column, decimals: Column, scale: Column, qualifier: Column, rounding: float = 1.0, scaled_by: float = 0.005, about_by: float = 0.05) -> tuple[Column, Column]:
    """The least and the greatest magnitude that ``matches`` may accept, and a little more on both sides for rounding."""
    size, half = F.abs(cited), F.lit(0.5 * rounding) * F.pow(F.lit(10.0), -decimals)
    target = size * scale
    low, high = (size - half) * scale, (size + half) * scale
    low, high = F.when(scale > 1, F.least(low, target / (1 + scaled_by))).otherwise(low), F.when(scale > 1, F.greatest(high, target / (1 - scaled_by))).otherwise(high)
    low = F.when(qualifier == "approx", F.least(low, target / (1 + about_by))).when(qualifier == "under", F.least(low, target / 1.5)).otherwise(low)
    high = F.when(qualifier == "approx", F.greatest(high, target / (1 - about_by))).when(qualifier == "over", F.greatest(high, target * 1.5)).otherwise(high)
    return F.greatest(low * (1 - 1e-6) - 1e-6 * scale, F.lit(0.0)), high * (1 + 1e-6) + 1e-6 * scale


def places(cited: Column, decimals: Column, scale: Column, qualifier: Column, unit: Column, is_rank: Column, is_ratio: Column, **tolerance: float) -> Column:
    """``unit`` and ``cell`` of every value that a citation may mean: the units that it may meet, and the cells that it reaches."""
    low, high = reach(cited, decimals, scale, qualifier, **tolerance)
    units = F.when(is_rank, F.array(F.lit("rank"))).when(is_ratio, F.array(F.lit("ratio"))).when(unit == "plain", F.array(*map(F.lit, CLASSES))).otherwise(F.array(unit))
    return F.flatten(F.transform(F.sequence(cell(low), cell(high)), lambda c: F.transform(units, lambda u: F.struct(u.alias("unit"), c.alias("cell")))))
