"""Seasonal naive forecasts and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import chunks as C
from tidegrid.operators.metrics import scored_metrics
from tidegrid.operators.splits import RollingOrigin

# One week of hours, and the name under which results are reported.
WEEK_STEPS = 168
MODEL_NAME = "seasonal_naive_weekly"


def seasonal_naive(
    df: DataFrame,
    *,
    value: str,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    season: int = WEEK_STEPS,
    mode: str = "rows",
    forecast: str = "forecast",
    rows: int | None = None,
) -> DataFrame:
    """Forecast each row by an earlier actual of the same series.

    ``mode="rows"`` looks ``season`` rows back among the rows given (rows without
    a target were dropped, so this is not always a fixed time); ``mode="time"``
    looks exactly ``season`` steps back. Either way one shuffle by series and chunk
    after the positions are known.
    """
    C.time_type(df, ts)
    keys = list(series_keys)
    if mode == "rows":
        numbered = C.add_row_number(df, ts=ts, series_keys=keys, step=step, name="_row", rows=rows)
        chunked = C.add_chunks(numbered, F.col("_row").cast("bigint"), back=season, rows=rows)
        earlier = F.lag(value, season).over(C.chunk_window(keys))
    elif mode == "time":
        chunked = C.add_chunks(df, C.grid_position(F.col(ts), step), back=season, rows=rows)
        frame = C.chunk_window(keys).rangeBetween(-season, -season)
        earlier = F.max(value).over(frame)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return C.drop_halo(chunked.withColumn(forecast, earlier)).select(*df.columns, forecast)


def require_history(
    forecasts: DataFrame, *, forecast: str = "forecast", scored: Sequence[str] = ("validation", "test")
) -> DataFrame:
    """Fail the job when a scored row has no actual one season back."""
    missing = F.col("split").isin(*scored) & F.col(forecast).isNull()
    error = F.raise_error(F.lit("seasonal lag exceeds the available history")).cast("double")
    return forecasts.withColumn(forecast, F.when(missing, error).otherwise(F.col(forecast)))


def evaluate_seasonal_naive(
    df: DataFrame,
    *,
    value: str,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    season: int = WEEK_STEPS,
    mode: str = "rows",
    strict: bool = True,
) -> DataFrame:
    """MAE and RMSE per scored split; history runs through all earlier splits.

    A scored row without history is an error; with ``strict=False`` it is left out
    of the means and counted as ``unscored_count``.
    """
    known = df.where(F.col(value).isNotNull())
    forecasts = seasonal_naive(
        known, value=value, ts=ts, series_keys=series_keys, step=step, season=season, mode=mode
    )
    if strict:
        forecasts = require_history(forecasts)
    scored = forecasts.where(F.col("split").isin("validation", "test"))
    return scored_metrics(scored, actual=value, by=["split"]).withColumn("model_name", F.lit(MODEL_NAME))


def walk_forward_naive(
    df: DataFrame,
    folds: RollingOrigin,
    *,
    value: str,
    ts: str,
    series_keys: Sequence[str] = (),
    season: int = WEEK_STEPS,
    rows: int | None = None,
) -> DataFrame:
    """Forecast every fold's scored rows from actuals at or before its origin.

    The actual lies the smallest number of whole seasons back that reaches the
    origin, so horizons longer than a season work too. All lookups are frames
    over one window order on a grid of times.
    """
    C.time_type(df, ts)
    keys = list(series_keys)
    most = -(-folds.horizon // season)
    chunked = C.add_chunks(
        df, C.grid_position(F.col(ts), folds.step), back=most * season, rows=rows
    )
    window = C.chunk_window(keys)
    lookups = {
        f"_season{m}": F.max(value).over(window.rangeBetween(-m * season, -m * season))
        for m in range(1, most + 1)
    }
    history = C.drop_halo(chunked.withColumns(lookups))
    scored = folds.scored_rows(history, ts)
    whole_seasons = F.ceil(F.col("lead_steps") / season)
    forecast = F.coalesce(
        *[F.when(whole_seasons == m, F.col(f"_season{m}")) for m in range(1, most + 1)]
    )
    return scored.withColumn("forecast", forecast).drop(*lookups)
