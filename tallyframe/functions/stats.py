"""Scalar statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Terms of the series and bound beyond which 0 or 1 is exact to six digits or more.
TERMS, FAR = 60, 6.0


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function.

    The series phi(z) * sum z^(2k+1) / (1*3*...*(2k+1)) has positive terms only, so no digits cancel.
    """
    x = F.abs(z)
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    half = F.aggregate(steps, start, add, lambda s: s["sum"]) * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    above = F.when(x > FAR, F.lit(1.0)).otherwise(F.least(F.lit(0.5) + half, F.lit(1.0)))
    return F.when(z < 0, 1 - above).otherwise(above)


def clamp(x: Column) -> Column:
    """x kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
