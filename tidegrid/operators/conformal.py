"""Split-conformal calibration of prediction intervals (Romano, Patterson and Candes 2019)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.chunks import keyed_lookup
from tidegrid.operators.order_stats import LEFT, order_statistic


def conformal_adjustment(
    scored: DataFrame,
    *,
    actual: str,
    lower: str = "pred_q10",
    upper: str = "pred_q90",
    level: float = 0.8,
    keys: Sequence[str] = (),
    left: int = LEFT,
) -> DataFrame:
    """Adjustment per group: the score of rank ``ceil((n + 1) * level)``.

    The score is how far the actual lies outside the interval, negative inside.
    A rank beyond n gives NULL: only an unbounded interval reaches the level.
    """
    a = F.col(actual)
    score = F.greatest(F.col(lower) - a, a - F.col(upper))
    scores = scored.where(a.isNotNull()).select(*keys, score.alias("_score"))
    # The small offset keeps float rounding of (n + 1) * level from moving the rank.
    return order_statistic(
        scores,
        "_score",
        {"adjustment": lambda n: F.ceil((n + 1) * F.lit(level) - F.lit(1e-9))},
        keys=keys,
        left=left,
    )


def conformal_calibrate(
    predictions: DataFrame,
    *,
    actual: str,
    lower: str = "pred_q10",
    upper: str = "pred_q90",
    level: float = 0.8,
    keys: Sequence[str] = (),
    split: str = "split",
    calibrate_on: str = "validation",
    left: int = LEFT,
) -> DataFrame:
    """Widen every interval by the adjustment learned on the validation rows of its group.

    Adds ``adjustment``, ``calibrated_lower`` and ``calibrated_upper``; the median
    forecast stays as it is. An unbounded interval has infinite ends.
    """
    fitted = conformal_adjustment(
        predictions.where(F.col(split) == calibrate_on),
        actual=actual,
        lower=lower,
        upper=upper,
        level=level,
        keys=keys,
        left=left,
    ).select(*keys, "adjustment")
    widen = F.coalesce(F.col("adjustment"), F.lit(float("inf")))
    return keyed_lookup(predictions, fitted, keys).withColumns(
        {"calibrated_lower": F.col(lower) - widen, "calibrated_upper": F.col(upper) + widen}
    )
