"""Pivots, best-of selections and last-n cuts of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(label: str, names: Sequence[str]) -> Column:
    """The label column; a label outside ``names`` fails the job instead of being left out of a pivot."""
    unknown = F.raise_error(F.concat(F.lit(f"{label} is not in the list: "), F.col(label).cast("string")))
    return F.when(F.col(label).isNull() | F.col(label).isin(*names), F.col(label)).otherwise(unknown.cast("string"))


def pivot_models(
    metrics: DataFrame,
    models: Sequence[str],
    *,
    row: str = "horizon",
    model: str = "model",
    value: str = "rmse",
) -> DataFrame:
    """One column per model, in alphabetical order.

    A repeated (row, model) pair fails the job, and so does a model outside ``models``.
    """
    count = F.count(F.lit(1))
    single = F.when(count == 1, F.max(value)).otherwise(
        F.raise_error(F.lit("duplicate entries for one row and model")).cast("double")
    )
    unique = metrics.withColumn(model, listed(model, models)).groupBy(row, model).agg(single.alias(value))
    return unique.groupBy(row).pivot(model, sorted(models)).agg(F.max(value))


def add_best_model(pivoted: DataFrame, models: Sequence[str]) -> DataFrame:
    """Row-wise arg-min and minimum over model columns; NULL is skipped, ties go to the first name."""
    names = sorted(models)
    numbers = {m: F.col(m).try_cast("double") for m in names}
    lowest = F.array_min(F.array(*numbers.values()))
    winner = F.coalesce(*[F.when(numbers[m] == lowest, F.lit(m)) for m in names])
    return pivoted.withColumns(numbers).withColumns({"best_model": winner, "best_rmse": lowest})


def rank_by(df: DataFrame, metric: str, tie_break: str) -> DataFrame:
    """Ascending by metric, missing metrics last."""
    return df.orderBy(F.col(metric).asc_nulls_last(), F.col(tie_break))


def best_by(
    df: DataFrame,
    metric: str,
    tie_break: str,
    *,
    columns: Sequence[str],
    by: Sequence[str] = (),
    worst: bool = False,
) -> DataFrame:
    """The row with the lowest (or highest) metric per group, as an aggregate without a sort."""
    present = df.where(F.col(metric).isNotNull())
    row = F.struct(*columns)
    order = F.struct(-F.col(metric) if worst else F.col(metric), F.col(tie_break))
    return present.groupBy(*by).agg(F.min_by(row, order).alias("_best")).where(
        F.col("_best").isNotNull()
    ).select(*by, "_best.*")


def last_rows(df: DataFrame, n: int, *, ts: str, series_keys: Sequence[str] = ()) -> DataFrame:
    """The last n rows in time order with their sequence number from 0, per series when keyed.

    The rank limit is applied before the shuffle as well, so a hot series sends
    at most n rows per input task.
    """
    keys = list(series_keys)
    if keys:
        newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
        tail = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n)
    else:
        tail = df.orderBy(F.col(ts).desc()).limit(n)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1
    return tail.withColumn("sequence", number).select(*df.columns, "sequence")
