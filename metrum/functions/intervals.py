"""Column expressions over intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length both share, at least 0."""
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap as a share of the union; 0 for an empty union."""
    both = overlap(s1, e1, s2, e2)
    return ratio(both, (e1 - s1) + (e2 - s2) - both, 0.0)


def distance(t: Column, s: Column, e: Column) -> Column:
    """How far a point lies outside of an interval; 0 inside."""
    return F.greatest(s - t, t - e, F.lit(0))


def ratio(n: Column, d: Column, default: float = 1.0) -> Column:
    """n / d; the default where d is 0 or null. Success rates default to 1, errors and leakage to 0."""
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(n.cast("double") / d)


def smooth(x: Column) -> Column:
    """3x^2 - 2x^3 on [0, 1], clamped outside."""
    c = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return c * c * (F.lit(3.0) - F.lit(2.0) * c)


def min_jerk(x: Column) -> Column:
    """10x^3 - 15x^4 + 6x^5 on [0, 1], clamped outside."""
    c = F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return c * c * c * (F.lit(10.0) + c * (F.lit(6.0) * c - F.lit(15.0)))
