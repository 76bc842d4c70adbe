"""Scalar expressions and plan-time schema checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO duration tokens of the feed and their length in minutes.
RESOLUTION_MINUTES = {"PT15M": 15, "PT30M": 30, "PT60M": 60, "PT1H": 60}

UNKNOWN_LABEL = "UNKNOWN"


def resolution_minutes(token: Column) -> Column:
    """Length of an ISO duration token in minutes; an unknown or missing token fails the job."""
    result = F.when(F.lit(False), F.lit(0))
    for text, minutes in RESOLUTION_MINUTES.items():
        result = result.when(token == text, F.lit(minutes))
    message = F.concat(F.lit("unsupported resolution: "), F.coalesce(token, F.lit("missing")))
    return result.otherwise(F.raise_error(message).cast("int"))


def parse_period_start(text: Column) -> Column:
    """``2024-01-01T00:00Z`` (seconds optional) to a timestamp; missing or bad text fails the job."""
    parsed = F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
    )
    message = F.concat(F.lit("bad period start: "), F.coalesce(text, F.lit("missing")))
    return F.coalesce(parsed, F.raise_error(message).cast("timestamp"))


def point_timestamp(start: Column, minutes: Column, position: Column) -> Column:
    """Time of the 1-based ``position`` in a period of equal intervals."""
    checked = F.coalesce(
        position.cast("int"), F.raise_error(F.lit("missing point position")).cast("int")
    )
    return F.timestamp_add("MINUTE", (checked - 1) * minutes, start)


def add_point_timestamps(
    df: DataFrame,
    *,
    ts: str = "timestamp_utc",
    start: str = "period_start",
    resolution: str = "resolution",
    position: str = "position",
) -> DataFrame:
    """Rebuild clock time from period start, resolution and position."""
    return df.withColumn(
        ts,
        point_timestamp(
            parse_period_start(F.col(start)), resolution_minutes(F.col(resolution)), F.col(position)
        ),
    )


def redact_token(url: Column, parameter: str = "securityToken") -> Column:
    """Hide the value of one URL parameter; NULL stays NULL."""
    return F.regexp_replace(url, f"({parameter}=)[^&]+", "$1REDACTED")


def label_or_unknown(label: Column) -> Column:
    return F.coalesce(label, F.lit(UNKNOWN_LABEL))


def parse_utc(text: Column) -> Column:
    """Any timestamp text as UTC (the session time zone is UTC)."""
    return F.to_timestamp(text)


def parse_hour_key(key: Column) -> Column:
    """``yyyyMMddHH`` to a timestamp."""
    return F.to_timestamp(key, "yyyyMMddHH")


def clean_text(text: Column) -> Column:
    return F.trim(text)


def text_to_int(text: Column) -> Column:
    return F.trim(text).cast("int")


def text_to_double(text: Column) -> Column:
    return F.trim(text).cast("double")


def to_number(value: Column) -> Column:
    """Numeric coercion: text that is no number becomes NULL."""
    return value.try_cast("double")


def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def missing_flag(value: Column) -> Column:
    return value.isNull().cast("int")


def available_flag(value: Column) -> Column:
    return value.isNotNull().cast("int")


def add_missing_flags(df: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    """One 0/1 missing flag per column, named ``{column}{suffix}``, in a single projection."""
    return df.withColumns({f"{c}{suffix}": missing_flag(F.col(c)) for c in columns})


def variant_value(payload: Column, path: str, data_type: str, default: Column | None = None) -> Column:
    """Value at a nested JSON path, or the default when any step of the path is absent."""
    found = F.try_variant_get(payload, path, data_type)
    return found if default is None else F.coalesce(found, default)


def first_present(
    payload: Column, paths: Sequence[str], data_type: str, missing_message: str | None = None
) -> Column:
    """First of several paths that holds a value; optionally an error when none does."""
    candidates = [F.try_variant_get(payload, path, data_type) for path in paths]
    if missing_message is not None:
        candidates.append(F.raise_error(F.lit(missing_message)).cast(data_type))
    return F.coalesce(*candidates)


# Places where a model summary may keep its error, in order of preference.
RMSE_PATHS = (
    "$.test_rmse",
    "$.rmse",
    "$.rmse_test",
    "$.test_error",
    "$.test_metrics.point_metrics.RMSE",
    "$.validation_metrics.point_metrics.RMSE",
)
COVERAGE_PATHS = ("$.test_metrics.coverage_80_interval", "$.test_coverage_80_interval")


def calibration_label(coverage: Column, nominal: float = 0.8, tolerance: float = 0.05) -> Column:
    """Where empirical coverage lies relative to the nominal level; NULL is inconclusive."""
    low, high = round(nominal - tolerance, 10), round(nominal + tolerance, 10)
    return (
        F.when(coverage.isNull(), F.lit("inconclusive"))
        .when(coverage < low, F.lit("under-covered"))
        .when(coverage > high, F.lit("over-covered"))
        .otherwise(F.lit("reasonably calibrated"))
    )


def ordered_label(label: Column, order: Sequence[str]) -> Column:
    """Sort key of an ordered category; labels outside the order sort last."""
    place = F.array_position(F.array(*[F.lit(o) for o in order]), label)
    return F.when(place > 0, place)


def column_with_prefix(df: DataFrame, prefix: str) -> str:
    """First column whose name starts with ``prefix``; fails at plan time when there is none."""
    for name in df.columns:
        if name.startswith(prefix):
            return name
    raise ValueError(f"no column starts with {prefix!r}: {df.columns}")


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {absent}")
    return df


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add each absent column as a typed NULL."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def add_constants(df: DataFrame, **constants: object) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})
