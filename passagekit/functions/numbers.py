"""Number helpers: rounding half up, and values that must be finite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, places: int = 0) -> Column:
    """floor(x * 10**places + 0.5) / 10**places: halves go up, negative ones too."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
