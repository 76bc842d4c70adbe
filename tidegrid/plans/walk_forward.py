"""Rolling-origin evaluation: metrics per fold, then their mean and deviation over folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.models.least_squares import fit_expanding, linear_value
from tidegrid.operators import chunks as C
from tidegrid.operators.metrics import scored_metrics
from tidegrid.operators.splits import RollingOrigin


def fold_metrics(
    forecasts: DataFrame, *, actual: str, forecast: str = "forecast", by: Sequence[str] = ()
) -> DataFrame:
    """MAE and RMSE per fold; rows without a forecast are counted as ``unscored_count``."""
    return scored_metrics(forecasts, actual=actual, forecast=forecast, by=[*by, "fold"])


def summarise_folds(per_fold: DataFrame, metrics: Sequence[str] = ("mae", "rmse"), by: Sequence[str] = ()) -> DataFrame:
    """Number of folds with the mean and sample deviation of each metric, and all unscored rows."""
    columns = [F.count(F.lit(1)).alias("folds"), F.sum("unscored_count").alias("unscored_count")]
    for m in metrics:
        columns += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return per_fold.groupBy(*by).agg(*columns)


def walk_forward(
    df: DataFrame,
    folds: RollingOrigin,
    fit_predict: Callable[[DataFrame, DataFrame], DataFrame],
    *,
    ts: str,
) -> DataFrame:
    """Run a model on every fold: it gets the training rows and the rows to forecast.

    Fits are jobs started one after the other; predictions stay distributed.
    """
    scored = folds.scored_rows(df, ts)
    parts = [
        fit_predict(folds.training_rows(df, k, ts), scored.where(F.col("fold") == k))
        for k in range(1, folds.folds + 1)
    ]
    return reduce(DataFrame.unionByName, parts)


def walk_forward_least_squares(
    df: DataFrame, folds: RollingOrigin, *, y: str, x: Sequence[str], ts: str, series_keys: Sequence[str] = ()
) -> DataFrame:
    """Every fold's scored rows with ``forecast``, from a fit on all rows at or before its origin.

    All folds are fitted from one pass over the rows (see ``fit_expanding``). Regressors must be
    known at the origin, such as lags of at least the horizon.
    """
    C.time_type(df, ts)
    keys = list(series_keys)
    train = df.withColumn("_part", folds.first_fold(ts))
    fits = fit_expanding(train, y=y, x=x, part="_part", last_part=folds.folds, keys=keys)
    joined = C.keyed_lookup(folds.scored_rows(df, ts), fits.select(*keys, "fold", "coefficients"), [*keys, "fold"])
    return joined.withColumn("forecast", linear_value(x)).drop("coefficients")
