"""Exact aggregates with defined ties and empty results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics; 0 for no values."""
    return F.coalesce(F.percentile(x.cast("double"), F.lit(q)), F.lit(0.0))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def weighted_mean(x: Column, w: Column) -> Column:
    """Sum of x * w over the sum of w; 0 without weight."""
    return F.when(F.coalesce(F.sum(w), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.sum(x * w) / F.sum(w))


def mode_smallest(key: Column, count: Column) -> Column:
    """The key with the largest count, the smallest key of several; for numeric keys."""
    return F.max_by(key, F.struct(count, -key))


def most_common_first(key: Column, count: Column, first: Column) -> Column:
    """The key with the largest count, the one seen first of several."""
    return F.max_by(key, F.struct(count, -first))


def rms(x: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def half_up(x: Column, digits: int) -> Column:
    """Not negative numbers rounded half up in binary arithmetic, as any engine does it that has floor."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + 0.5) / scale
