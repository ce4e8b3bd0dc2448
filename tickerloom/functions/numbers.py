"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c: Column | str, digits: int = 4) -> Column:
    """Half-up rounding in plain double arithmetic (stays inside codegen, no BigDecimal)."""
    scale = float(10**digits)
    return F.floor(col(c) * scale + 0.5) / scale


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Bound a value; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")
