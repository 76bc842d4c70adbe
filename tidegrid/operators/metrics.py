"""Metric tables: every measure of a forecast in one grouped aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import errors as E

# Quantile columns of the prediction table and their levels.
QUANTILES = {"pred_q10": 0.1, "pred_q50": 0.5, "pred_q90": 0.9}
# Prediction intervals by nominal percentage.
INTERVALS = {80: ("pred_q10", "pred_q90")}


def point_metrics(
    df: DataFrame, *, actual: str, forecast: str, by: Sequence[str] = ()
) -> DataFrame:
    """MAE and RMSE; rows without an actual do not count."""
    a, f = F.col(actual), F.col(forecast)
    return df.where(a.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), E.mae(a, f).alias("mae"), E.rmse(a, f).alias("rmse")
    )


def quantile_metrics(
    actual: Column,
    median: Column,
    quantiles: Mapping[str, float] = QUANTILES,
    intervals: Mapping[int, tuple[str, str]] = INTERVALS,
) -> list[Column]:
    """Aggregates for point error, pinball loss per level, coverage and width per interval."""
    columns = [E.mae(actual, median).alias("mae"), E.rmse(actual, median).alias("rmse")]
    for name, alpha in quantiles.items():
        columns.append(E.pinball(actual, F.col(name), alpha).alias(name.replace("pred_", "pinball_")))
    for percent, (lower, upper) in intervals.items():
        columns.append(E.coverage(actual, F.col(lower), F.col(upper)).alias(f"coverage_{percent}"))
        columns.append(E.width(F.col(lower), F.col(upper)).alias(f"width_{percent}"))
    return columns


def metric_table(
    df: DataFrame,
    *,
    actual: str,
    by: Sequence[str] = (),
    median: str = "pred_q50",
    quantiles: Mapping[str, float] = QUANTILES,
    intervals: Mapping[int, tuple[str, str]] = INTERVALS,
) -> DataFrame:
    """All measures per group, such as horizon, model and split."""
    return df.where(F.col(actual).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *quantile_metrics(F.col(actual), F.col(median), quantiles, intervals),
    )


def scored_metrics(
    df: DataFrame, *, actual: str, forecast: str = "forecast", by: Sequence[str] = ()
) -> DataFrame:
    """MAE and RMSE over known rows with a forecast; known rows without one are ``unscored_count``."""
    a, f = F.col(actual), F.col(forecast)
    return df.where(a.isNotNull()).groupBy(*by).agg(
        F.count(f).alias("row_count"),
        F.count(F.when(f.isNull(), F.lit(1))).alias("unscored_count"),
        E.mae(a, f).alias("mae"),
        E.rmse(a, f).alias("rmse"),
    )


def interval_coverage_by_level(
    df: DataFrame, *, actual: str, intervals: Mapping[int, tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """Coverage and width of each nominal interval as rows, from one pass over the data."""
    a = F.col(actual)
    sums = []
    for percent, (lower, upper) in intervals.items():
        sums.append(E.coverage(a, F.col(lower), F.col(upper)).alias(f"coverage_{percent}"))
        sums.append(E.width(F.col(lower), F.col(upper)).alias(f"width_{percent}"))
    entries = [
        F.struct(
            F.lit(percent / 100).alias("nominal"),
            F.col(f"coverage_{percent}").alias("coverage"),
            F.col(f"width_{percent}").alias("width"),
        )
        for percent in intervals
    ]
    return (
        df.where(a.isNotNull())
        .groupBy(*by)
        .agg(*sums)
        .select(*by, F.inline(F.array(*entries)))
    )
