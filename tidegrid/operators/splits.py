"""Chronological splits and rolling-origin folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import chunks as C

SPLITS = ("train", "validation", "test")


def half_open_split(
    ts: Column,
    train_end: Column,
    validation_end: Column,
    *,
    embargo: int = 0,
    step: str = "1 hour",
) -> Column:
    """train up to T, validation in (T, V], test after V; every time falls in one split.

    ``embargo=h`` drops origins whose target, h steps ahead, lies beyond the end
    of their own split, so that no training target is a validation value.
    """
    label = (
        F.when(ts <= train_end, F.lit("train"))
        .when(ts <= validation_end, F.lit("validation"))
        .when(ts > validation_end, F.lit("test"))
    )
    if embargo == 0:
        return label
    target = F.timestamp_add("SECOND", F.lit(embargo * C.step_micros(step) // 1_000_000), ts)
    crosses = ((ts <= train_end) & (target > train_end)) | (
        (ts > train_end) & (ts <= validation_end) & (target > validation_end)
    )
    return F.when(~crosses, label)


def closed_split(
    ts: Column,
    train_end: Column,
    validation_start: Column,
    validation_end: Column,
    test_start: Column,
) -> Column:
    """train up to T, validation in [V0, V1], test from S; times in between belong to none."""
    return (
        F.when(ts <= train_end, F.lit("train"))
        .when((ts >= validation_start) & (ts <= validation_end), F.lit("validation"))
        .when(ts >= test_start, F.lit("test"))
    )


def add_split(df: DataFrame, label: Column) -> DataFrame:
    """Add the split label and drop rows that belong to no split."""
    return df.withColumn("split", label).where(F.col("split").isNotNull())


def split_summary(df: DataFrame, *, ts: str = "timestamp_utc", by: tuple[str, ...] = ()) -> DataFrame:
    """Row count and time range of each split."""
    return df.groupBy(*by, "split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("start_utc"),
        F.max(ts).alias("end_utc"),
    )


def before_test(df: DataFrame) -> DataFrame:
    """Training and validation rows together, for the final refit."""
    return df.where(F.col("split").isin("train", "validation"))


@dataclass(frozen=True)
class RollingOrigin:
    """Evenly spaced forecast origins with an expanding training window.

    Fold k (from 1) has its origin ``(k - 1) * stride`` steps after ``first_origin``
    and is scored on the ``horizon`` steps after the origin.
    """

    first_origin: str
    stride: int
    horizon: int
    folds: int
    step: str = "1 hour"

    def origin(self, fold: int) -> Column:
        seconds = (fold - 1) * self.stride * C.step_micros(self.step) // 1_000_000
        start = F.lit(self.first_origin).cast("timestamp_ntz")
        return F.timestamp_add("SECOND", F.lit(seconds), start)

    def _origin_position(self) -> Column:
        return C.grid_position(F.lit(self.first_origin).cast("timestamp_ntz"), self.step)

    def training_rows(self, df: DataFrame, fold: int, ts: str) -> DataFrame:
        """Rows at or before the origin of one fold."""
        return df.where(F.col(ts) <= self.origin(fold).cast(C.time_type(df, ts)))

    def first_fold(self, ts: str) -> Column:
        """The first fold that trains on a row; beyond ``folds`` if none does."""
        behind = C.grid_position(F.col(ts), self.step) - self._origin_position()
        return F.greatest(-C.floor_div(-behind, self.stride) + 1, F.lit(1).cast("bigint")).cast("int")

    def scored_rows(self, df: DataFrame, ts: str) -> DataFrame:
        """Rows to forecast, once per fold they belong to, with ``fold`` and ``lead_steps``.

        Fold numbers follow from the time by arithmetic, so there is no range join
        and no row is copied to folds that do not score it.
        """
        C.time_type(df, ts)
        offset = C.grid_position(F.col(ts), self.step) - self._origin_position() - 1
        first = F.greatest(C.floor_div(offset - self.horizon, self.stride) + 2, F.lit(1).cast("bigint"))
        last = F.least(C.floor_div(offset, self.stride) + 1, F.lit(self.folds).cast("bigint"))
        lead = offset + 1 - (F.col("fold") - 1) * self.stride
        return (
            df.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first, last))))
            .withColumn("lead_steps", lead.cast("int"))
            .withColumn("fold", F.col("fold").cast("int"))
        )
