"""Coverage and quality profiles; each profile is one aggregation pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import chunks as C


def coverage_profile(
    df: DataFrame, *, ts: str, value: str, by: Sequence[str] = (), flags: Sequence[str] = ()
) -> DataFrame:
    """Row count, time range, NULL count and the sums of 0/1 flags."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("start_utc"),
        F.max(ts).alias("end_utc"),
        F.count_if(F.col(value).isNull()).alias("missing_count"),
        *[F.sum(flag).alias(f"{flag}_sum") for flag in flags],
    )


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """Distinct non-NULL labels in order, as rows rather than one unbounded list."""
    return df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label)


def label_profile(df: DataFrame, *, label: str, value: str) -> DataFrame:
    """Rows, NULLs, minimum and maximum per label; a NULL label is a group of its own."""
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(value).isNull()).alias("missing_values"),
        F.min(value).alias(f"min_{value}"),
        F.max(value).alias(f"max_{value}"),
    )


def duplicate_count(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first with the same key; NULL keys count as equal."""
    per_key = df.groupBy(*dict.fromkeys([*by, *keys])).agg(F.count(F.lit(1)).alias("_rows"))
    return per_key.groupBy(*by).agg(F.sum(F.col("_rows") - 1).alias("duplicate_count"))


def series_audit(
    df: DataFrame,
    *,
    ts: str,
    value: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Expected, observed, missing, NULL and duplicate counts and the range of each series.

    Rows are first combined per 64 steps, whose times are bits of a number, and times
    off the grid one by one. So a repeated time or a hot series shrinks before the
    shuffle, and a task holds a 64th of its grid rows. The lists behind the counts are
    tables of their own (missing_timestamps, null_rows).
    """
    C.time_type(df, ts)
    keys = list(series_keys)
    position = C.grid_position(F.col(ts), step)
    on_grid = C.micros(F.col(ts)) == position * C.step_micros(step)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))
    inside = on_grid
    if start is not None:
        inside = inside & (F.col(ts) >= start)
    if end is not None:
        inside = inside & (F.col(ts) <= end)
    # A NULL time is one time off the grid.
    per_word = df.groupBy(*keys, C.floor_div(position, 64).alias("_word"), F.when(~on_grid, F.col(ts)).alias("_off")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col(value).isNull()).alias("_nulls"),
        F.bit_or(F.when(on_grid, bit)).alias("_times"),
        F.bit_or(F.when(inside, bit)).alias("_inside"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
    )
    low = F.min(C.grid_position(F.col("_first"), step)) if start is None else F.max(C.grid_position(start, step))
    high = F.max(C.grid_position(F.col("_last"), step)) if end is None else F.max(C.grid_position(end, step))
    expected = high - low + 1
    times = F.coalesce(F.bit_count("_times"), F.lit(1))
    return per_word.groupBy(*keys).agg(
        expected.alias("expected_count"),
        F.sum("_rows").alias("observed_count"),
        (expected - F.sum(F.coalesce(F.bit_count("_inside"), F.lit(0)))).alias("missing_count"),
        F.sum("_nulls").alias("null_count"),
        F.sum(F.col("_rows") - times).alias("duplicate_count"),
        F.min("_first").alias("start_utc"),
        F.max("_last").alias("end_utc"),
    )


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def present_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def column_quality(
    df: DataFrame,
    columns: Sequence[str],
    *,
    raw_suffix: str = "_missing_flag_raw",
    postfill_suffix: str = "_missing_flag_postfill",
) -> DataFrame:
    """Missing counts before and after filling, one row per column, from one wide pass."""
    sums = []
    for c in columns:
        sums.append(F.sum(f"{c}{raw_suffix}").alias(f"raw_{c}"))
        sums.append(F.sum(f"{c}{postfill_suffix}").alias(f"post_{c}"))
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"raw_{c}").alias("raw_missing_count"),
            F.col(f"post_{c}").alias("postfill_missing_count"),
        )
        for c in columns
    ]
    return df.agg(*sums).select(F.inline(F.array(*entries)))
