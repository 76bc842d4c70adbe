"""From hourly series to supervised, split forecasting tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import add_calendar_features
from tidegrid.functions.scalars import add_missing_flags, available_flag, label_or_unknown, missing_flag
from tidegrid.operators import chunks as C
from tidegrid.operators import features as X
from tidegrid.operators import horizons as H
from tidegrid.operators.fill import interpolate
from tidegrid.operators.grid import align_to_grid, collapse_duplicates, join_on_time, resample_mean

# Feed label of onshore wind; longest gaps filled for wind and weather, in rows.
ONSHORE_WIND = "B19"
WIND_LIMIT = 3
WEATHER_LIMIT = 6


def hourly_load(
    points: DataFrame, ts: str = "timestamp_utc", step: str = "1 hour", materialize: bool = False
) -> DataFrame:
    """Points with rebuilt times to one hourly load series."""
    named = points.withColumnRenamed("quantity", "load_mw")
    return resample_mean(named, ts=ts, value="load_mw", step=step, materialize=materialize)


def hourly_generation(
    points: DataFrame, ts: str = "timestamp_utc", step: str = "1 hour", materialize: bool = False
) -> DataFrame:
    """Points to one hourly series per generation type, each over its own time range."""
    labelled = points.withColumn("psr_type", label_or_unknown(F.col("psr_type")))
    return resample_mean(
        labelled.withColumnRenamed("quantity", "generation_mw"),
        ts=ts,
        value="generation_mw",
        series_keys=("psr_type", "business_type"),
        step=step,
        materialize=materialize,
    )


def prepare_load(
    load: DataFrame, *, ts: str = "timestamp_utc", series_keys: Sequence[str] = (),
    start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """Target on the complete grid with its missing flag; target gaps are never filled."""
    kept = load.select(*series_keys, ts, "load_mw")
    aligned = align_to_grid(kept, ts=ts, series_keys=series_keys, start=start, end=end)
    return aligned.withColumn("load_missing_flag", missing_flag(F.col("load_mw")))


def prepare_wind(
    generation: DataFrame, *, ts: str = "timestamp_utc", label: str = ONSHORE_WIND,
    start: Column | None = None, end: Column | None = None, direction: str = "both",
) -> DataFrame:
    """Onshore wind on the complete grid, short gaps interpolated, flagged before and after."""
    wind = collapse_duplicates(
        generation.where(F.col("psr_type") == label)
        .select(ts, "generation_mw")
        .withColumnRenamed("generation_mw", "wind_onshore_mw"),
        ts=ts,
        value="wind_onshore_mw",
    )
    aligned = align_to_grid(wind, ts=ts, start=start, end=end)
    flagged = aligned.withColumn("wind_missing_flag_raw", missing_flag(F.col("wind_onshore_mw")))
    filled = interpolate(
        flagged, "wind_onshore_mw", ts=ts, limit=WIND_LIMIT, direction=direction
    )
    return filled.withColumn("wind_missing_flag_postfill", missing_flag(F.col("wind_onshore_mw")))


def build_modeling_table(
    load: DataFrame,
    wind: DataFrame,
    *,
    ts: str = "timestamp_utc",
    series_keys: Sequence[str] = (),
    shared_keys: Sequence[str] = (),
    exclude_current: bool = False,
) -> DataFrame:
    """Prepared target and wind joined on time, with calendar and history features."""
    merged = join_on_time(load, wind, ts=ts, keys=shared_keys)
    featured = X.add_history_features(
        add_calendar_features(merged, ts), ts=ts, series_keys=series_keys, exclude_current=exclude_current
    )
    return featured.withColumn("target_available_for_training", available_flag(F.col("load_mw")))


def add_weather(
    modeling: DataFrame,
    weather: DataFrame,
    columns: Sequence[str],
    *,
    ts: str = "timestamp_utc",
    series_keys: Sequence[str] = (),
    shared_keys: Sequence[str] = (),
    direction: str = "both",
) -> DataFrame:
    """Join weather, fill its short gaps by elapsed time, flag every column before and after."""
    names = list(columns)
    joined = join_on_time(modeling, weather.select(*shared_keys, ts, *names), ts=ts, keys=shared_keys)
    flagged = add_missing_flags(joined, names, "_missing_flag_raw")
    filled = interpolate(
        flagged, names, ts=ts, limit=WEATHER_LIMIT, series_keys=series_keys, method="time",
        direction=direction,
    )
    return add_missing_flags(filled, names, "_missing_flag_postfill")


def build_horizon_table(
    modeling: DataFrame,
    *,
    ts: str = "timestamp_utc",
    series_keys: Sequence[str] = (),
    horizons: Mapping[str, int] = H.HORIZONS,
) -> DataFrame:
    """Targets of every horizon beside the features, in one pass."""
    return H.add_horizon_targets(modeling, ts=ts, series_keys=series_keys, horizons=horizons)


def build_supervised_table(
    series: DataFrame,
    *,
    value: str,
    prefix: str,
    ts: str = "timestamp_utc",
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    lags: Sequence[int] = X.LAGS,
    rolling: Sequence[int] = (X.ROLLING_STEPS,),
    horizons: Mapping[str, int] = H.HORIZONS,
    exclude_current: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """History features and all horizon targets, sharing one shuffle and sort; steps may be absent."""
    C.time_type(series, ts)
    chunked = C.add_chunks(
        series,
        C.grid_position(F.col(ts), step),
        back=X.history_reach(lags, rolling),
        ahead=max(horizons.values()),
        rows=rows,
    )
    window = C.chunk_window(series_keys)
    added = X.history_columns(
        value, window, prefix=prefix, lags=lags, rolling=rolling, exclude_current=exclude_current
    ) | H.target_columns(value, ts, window, prefix=prefix, horizons=horizons)
    return C.drop_halo(chunked.withColumns(added))
