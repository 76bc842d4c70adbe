"""Least squares per series from distributed, mergeable covariances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _solver(size: int):
    """Slopes of many series at once from covariances (vectorised, one row per series)."""
    upper = np.triu_indices(size)

    @F.pandas_udf("array<double>")
    def solve(products: pd.Series, moments: pd.Series) -> pd.Series:
        gram = np.zeros((len(products), size, size))
        gram[:, upper[0], upper[1]] = np.array(products.tolist(), dtype=float)
        lower = np.transpose(gram, (0, 2, 1)).copy()
        lower[:, np.arange(size), np.arange(size)] = 0
        right = np.array(moments.tolist(), dtype=float)
        solution = np.linalg.pinv(gram + lower, rcond=1e-12, hermitian=True) @ right[:, :, None]
        return pd.Series(list(solution[:, :, 0]))

    return solve


@dataclass(frozen=True)
class Moments:
    """Names of the columns that hold a fit's size, means and covariances."""

    names: tuple[str, ...]

    @property
    def pairs(self) -> list[tuple[int, int]]:
        """Of the regressors and, last, the target."""
        return [(i, j) for i in range(len(self.names)) for j in range(i, len(self.names))]

    def aggregates(self) -> list[Column]:
        """One pass, merged between tasks; covariances are centred as they grow, so no level cancels."""
        return [
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"_mean{i}") for i, c in enumerate(self.names)],
            *[F.covar_pop(F.col(self.names[i]), F.col(self.names[j])).alias(f"_cov{i}_{j}") for i, j in self.pairs],
        ]

    def solved(self, moments: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Coefficients, intercept first, with ``n`` and ``rss``; groups with too few rows are left out."""
        size = len(self.names) - 1
        products = [F.col(f"_cov{i}_{j}") for i, j in self.pairs if j < size]
        with_target = [F.col(f"_cov{i}_{size}") for i in range(size)]
        fitted = moments.where(F.col("n") > size + 1)
        if size:
            fitted = fitted.withColumn("_slopes", _solver(size)(F.array(*products), F.array(*with_target)))
        else:
            fitted = fitted.withColumn("_slopes", F.array().cast("array<double>"))
        inner = lambda values: F.aggregate(
            F.zip_with("_slopes", F.array(*values).cast("array<double>"), lambda b, v: b * v), F.lit(0.0), lambda a, v: a + v
        )
        intercept = F.col(f"_mean{size}") - inner([F.col(f"_mean{i}") for i in range(size)])
        rest = F.col("n") * (F.col(f"_cov{size}_{size}") - inner(with_target))
        return fitted.select(
            *keys, "n", F.greatest(rest, F.lit(0.0)).alias("rss"), F.concat(F.array(intercept), "_slopes").alias("coefficients")
        )


def fit_least_squares(
    df: DataFrame, *, y: str, x: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Intercept and coefficients per series as ``coefficients``, with ``n`` and ``rss``.

    Only means and covariances leave the tasks that hold the rows, so a long or hot
    series costs no more than its share of the scan.
    """
    moments = Moments((*x, y))
    return moments.solved(df.dropna(subset=[y, *x]).groupBy(*keys).agg(*moments.aggregates()), keys)


def fit_expanding(
    df: DataFrame, *, y: str, x: Sequence[str], part: str, last_part: int, keys: Sequence[str] = ()
) -> DataFrame:
    """A fit per series and ``fold`` 1 to ``last_part``, on all rows whose integer ``part`` is at most the fold.

    Rows are read once: moments are made per part and added up over the parts before, shifted
    to the series' mean so that nothing cancels. A window holds one row per part of a series.
    """
    moments, keys = Moments((*x, y)), list(keys)
    size = range(len(moments.names))
    parts = df.dropna(subset=[y, *x]).where(F.col(part).between(1, last_part)).groupBy(*keys, F.col(part).cast("int").alias("_part"))
    made = parts.agg(*moments.aggregates())
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    n = F.col("n")
    centred = made.withColumns({f"_of{i}": F.col(f"_mean{i}") - F.sum(n * F.col(f"_mean{i}")).over(whole) / F.sum(n).over(whole) for i in size})
    added = {f"_sum{i}": n * F.col(f"_of{i}") for i in size} | {
        f"_sum{i}_{j}": n * (F.col(f"_cov{i}_{j}") + F.col(f"_of{i}") * F.col(f"_of{j}")) for i, j in moments.pairs
    }
    centre = {f"_centre{i}": F.col(f"_mean{i}") - F.col(f"_of{i}") for i in size}
    # A part without rows still has a fold: it stands as zeros.
    spread = centred.select(*keys, "_part", "n", *[v.alias(c) for c, v in {**added, **centre}.items()])
    following = F.lead("_part", 1, last_part + 1).over(whole.orderBy("_part"))
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    summed = spread.select(
        *keys, F.sequence(F.col("_part"), following - 1).alias("_folds"), F.sum("n").over(upto).alias("n"),
        *[F.sum(c).over(upto).alias(c) for c in added], *centre,
    ).withColumn("fold", F.explode("_folds"))
    mean = {i: F.col(f"_sum{i}") / n for i in size}
    ready = summed.select(
        *keys, "fold", "n", *[(F.col(f"_centre{i}") + mean[i]).alias(f"_mean{i}") for i in size],
        *[(F.col(f"_sum{i}_{j}") / n - mean[i] * mean[j]).alias(f"_cov{i}_{j}") for i, j in moments.pairs],
    )
    return moments.solved(ready, [*keys, "fold"])


def linear_value(x: Sequence[str], coefficients: str = "coefficients") -> Column:
    """Intercept plus the weighted regressors; NULL when a regressor is missing."""
    total = F.col(coefficients)[0]
    for i, name in enumerate(x, start=1):
        total = total + F.col(coefficients)[i] * F.col(name)
    return total
