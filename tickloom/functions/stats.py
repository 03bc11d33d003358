"""NULL-safe statistics usable as aggregates or over windows (ANSI mode stays on)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, NULL where bottom is zero."""
    return top / F.nullif(bottom, F.lit(0).cast("double"))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL below two rows or where either side is constant."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sign(value: Column) -> Column:
    return F.signum(value)
