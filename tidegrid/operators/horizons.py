"""Supervised targets several steps ahead."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.functions.scalars import available_flag
from tidegrid.operators import chunks as C

# Horizon labels and their lead in steps.
HORIZONS = {"t_plus_1": 1, "t_plus_24": 24, "t_plus_168": 168}


def target_columns(
    value: str, ts: str, window: WindowSpec, *, prefix: str, horizons: Mapping[str, int] = HORIZONS
) -> dict[str, Column]:
    """Future value, its time and its availability for each horizon, over one window order."""
    columns = {}
    for label, h in horizons.items():
        ahead = C.at_step(value, h, window)
        columns[f"{prefix}_target_{label}"] = ahead
        columns[f"target_timestamp_{label}"] = C.at_step(ts, h, window)
        columns[f"target_available_{label}"] = available_flag(ahead)
    return columns


def add_horizon_targets(
    df: DataFrame,
    *,
    value: str = "load_mw",
    ts: str = "timestamp_utc",
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    prefix: str = "load",
    horizons: Mapping[str, int] = HORIZONS,
    rows: int | None = None,
) -> DataFrame:
    """Targets of all horizons in one pass; a target whose row is absent is missing."""
    C.time_type(df, ts)
    chunked = C.add_chunks(
        df, C.grid_position(F.col(ts), step), ahead=max(horizons.values()), rows=rows
    )
    added = target_columns(
        value, ts, C.chunk_window(series_keys), prefix=prefix, horizons=horizons
    )
    return C.drop_halo(chunked.withColumns(added))


def long_horizons(
    df: DataFrame, *, prefix: str = "load", horizons: Mapping[str, int] = HORIZONS
) -> DataFrame:
    """One row per origin and horizon instead of one column set per horizon (no shuffle)."""
    entries = [
        F.struct(
            F.lit(label).alias("horizon"),
            F.lit(h).alias("lead_steps"),
            F.col(f"{prefix}_target_{label}").alias("target"),
            F.col(f"target_timestamp_{label}").alias("target_timestamp"),
            F.col(f"target_available_{label}").alias("target_available"),
        )
        for label, h in horizons.items()
    ]
    drop = {
        f"{stem}_{label}"
        for label in horizons
        for stem in (f"{prefix}_target", "target_timestamp", "target_available")
    }
    base = [c for c in df.columns if c not in drop]
    return df.select(*base, F.explode(F.array(*entries)).alias("_h")).select(*base, "_h.*")


def horizon_summary(long_df: DataFrame, ts: str = "timestamp_utc") -> DataFrame:
    """Rows, available and missing targets and the time range of each horizon, in one pass."""
    return long_df.groupBy("horizon", "lead_steps").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("target_available").alias("available_count"),
        F.sum(1 - F.col("target_available")).alias("missing_count"),
        F.min(ts).alias("start_utc"),
        F.max(ts).alias("end_utc"),
    )


def available_rows(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose 0/1 flag is set."""
    return df.where(F.col(flag) == 1)
