"""Edit similarity as Column expressions, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotewright.functions.normalize import normalize


def ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0.0 where both are empty, null where one is null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def ratio_from(a: Column, b: Column, least: float) -> Column:
    """The ratio where it is at least `least`, else null: the distance is followed only as far as it may go."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - F.lit(least)) * longest + F.lit(1e-6)).cast("int")
    distance = F.call_function("levenshtein", a, b, most)  # -1 beyond
    found = 1 - distance / longest
    return F.when((longest > 0) & (distance >= 0) & (found >= least), found)


def may_reach(a: Column, b: Column, least: float) -> Column:
    """False only where the lengths alone keep the ratio below `least`: a cheap test before the distance."""
    return F.least(F.length(a), F.length(b)) >= F.lit(least) * F.greatest(F.length(a), F.length(b)) - F.lit(1e-9)


def ratio_at(a: Column, b: Column, tier: str) -> Column:
    """The ratio of two texts at a tier."""
    return ratio(normalize(a, tier), normalize(b, tier))
