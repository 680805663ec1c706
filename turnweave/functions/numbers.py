"""Exact integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(n: Column, d) -> Column:
    """Whole part of n / d."""
    return F.call_function("div", n.cast("long"), d.cast("long") if isinstance(d, Column) else F.lit(d).cast("long"))


def half_even(n: Column, d: int) -> Column:
    """n / d rounded to the nearest integer, halves to the even one; all in integers. ``d`` > 0."""
    n = n.cast("long")
    rest = F.pmod(n, F.lit(d).cast("long"))
    low = div(n - rest, d)
    up = (2 * rest > d) | ((2 * rest == d) & (F.pmod(low, F.lit(2)) == 1))
    return low + F.when(up, 1).otherwise(0)
