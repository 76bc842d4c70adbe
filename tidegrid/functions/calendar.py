"""Calendar parts and their cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cycle lengths of hour, weekday and month.
HOURS_PER_DAY = 24
DAYS_PER_WEEK = 7
MONTHS_PER_YEAR = 12


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of the given period."""
    angle = 2 * math.pi * value / period
    return F.sin(angle), F.cos(angle)


def add_calendar_features(df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Hour, weekday (Monday is 0), month, day of year, and three cyclical pairs."""
    t = F.col(ts)
    sin_hour, cos_hour = cyclic(F.hour(t), HOURS_PER_DAY)
    sin_dow, cos_dow = cyclic(F.weekday(t), DAYS_PER_WEEK)
    sin_month, cos_month = cyclic(F.month(t) - 1, MONTHS_PER_YEAR)
    return df.withColumns(
        {
            "hour_of_day": F.hour(t),
            "day_of_week": F.weekday(t),
            "month": F.month(t),
            "day_of_year": F.dayofyear(t),
            "sin_hour": sin_hour,
            "cos_hour": cos_hour,
            "sin_dow": sin_dow,
            "cos_dow": cos_dow,
            "sin_month": sin_month,
            "cos_month": cos_month,
        }
    )
