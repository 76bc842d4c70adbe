"""Error measures as aggregate expressions; each works in one partial-aggregation pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(actual: Column, forecast: Column) -> Column:
    """Mean absolute error over rows where both sides are present."""
    return F.avg(F.abs(actual - forecast))


def rmse(actual: Column, forecast: Column) -> Column:
    """Root mean squared error over rows where both sides are present."""
    error = actual - forecast
    return F.sqrt(F.avg(error * error))


def pinball(actual: Column, forecast: Column, alpha: float) -> Column:
    """Mean pinball loss at quantile level ``alpha``."""
    residual = actual - forecast
    return F.avg(F.greatest(alpha * residual, (alpha - 1) * residual))


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    """Share of actuals inside the closed interval.

    Crossed bounds never cover, and neither does a missing bound. An unbounded
    side is an infinite bound.
    """
    inside = F.coalesce((actual >= lower) & (actual <= upper), F.lit(False))
    return F.avg(F.when(actual.isNotNull(), inside.cast("double")))


def width(lower: Column, upper: Column) -> Column:
    return F.avg(upper - lower)
