"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def phred(p: str | Column) -> Column:
    """-10 log10(p); null for null or p <= 0."""
    p = _col(p)
    return F.when(p > 0, F.abs(F.lit(-10.0) * F.log10(p)))


def phred_capped(p: str | Column, floor: float = 1e-8) -> Column:
    """Phred score no higher than that of `floor`, 0 for a missing p."""
    p = _col(p)
    top = F.when(p <= floor, F.lit(-10.0) * F.log10(F.lit(floor))).otherwise(phred(p))
    return F.coalesce(top, F.lit(0.0))


def without_nan(c: str | Column) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def half_even(x: float) -> int:
    """Sizes are rounded half to even, as Python's round does."""
    return int(round(x))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))
