"""Numeric rules: shares, null-skipping sums, cuts and nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, total: Column) -> Column:
    """part / total, rounded half up to two decimals from an integer numerator; null for a total of 0."""
    return F.when(total > 0, F.floor(part * 100 / total + 0.5) / 100)


def cut_rank(n: Column, fraction: float) -> Column:
    """The rank, from 1, at which the top (or bottom) fraction of n values ends."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(n * F.lit(fraction))))


def nearest_rank(values: Column, percent: float) -> Column:
    """The nearest-rank percentile of a sorted array; null for an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(values, F.greatest(F.lit(1), F.ceil(n * F.lit(percent / 100))).cast("int")))
