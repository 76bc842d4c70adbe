"""Comparison reports and the tables behind the figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions import errors as E
from tidegrid.functions import scalars as P
from tidegrid.operators import ranking as R
from tidegrid.operators.metrics import metric_table
from tidegrid.sources.constants import NOMINAL_COVERAGE

# The columns of the baseline comparison, in order.
BASELINE_COLUMNS = (
    "model_name",
    "model_family",
    "validation_mae",
    "validation_rmse",
    "test_mae",
    "test_rmse",
    "validation_pinball_q10",
    "validation_pinball_q50",
    "validation_pinball_q90",
    "validation_coverage_80",
    "test_pinball_q10",
    "test_pinball_q50",
    "test_pinball_q90",
    "test_coverage_80",
    "primary_selection_metric",
    "selection_metric_name",
)
_METRIC_COLUMNS = BASELINE_COLUMNS[2:14]
_HORIZON_METRICS = [
    f"{split}_{m}"
    for split in ("validation", "test")
    for m in ("mae", "rmse", "pinball_q10", "pinball_q50", "pinball_q90", "coverage_80")
]

# Fixed value: wording of the baseline summary.
BASELINE_SENTENCE = (
    "The strongest current point-forecast baseline is %s, and the strongest probabilistic "
    "baseline is %s. The observed 80%% interval coverage is %s, which is %s relative to the "
    "nominal target."
)

# Order of horizons in figures.
HORIZON_ORDER = ("t_plus_1", "t_plus_24", "t_plus_168")


def _normalized(summaries: DataFrame, name: Column, family: Column, paths: Mapping[str, str]) -> DataFrame:
    metrics = [
        F.try_variant_get("payload", paths[c], "double").alias(c)
        if c in paths
        else F.lit(None).cast("double").alias(c)
        for c in _METRIC_COLUMNS
    ]
    return summaries.select(name.alias("model_name"), family.alias("model_family"), *metrics).select(
        "*",
        F.col("test_rmse").alias("primary_selection_metric"),
        F.lit("test_rmse").alias("selection_metric_name"),
    )


def _flat_paths() -> dict[str, str]:
    return {
        f"{split}_{m}": f"$.{split}_metrics.{m.upper()}"
        for split in ("validation", "test")
        for m in ("mae", "rmse")
    }


def _quantile_paths() -> dict[str, str]:
    paths = {}
    for split in ("validation", "test"):
        for m in ("mae", "rmse"):
            paths[f"{split}_{m}"] = f"$.{split}_metrics.point_metrics.{m.upper()}"
        for q in ("q10", "q50", "q90"):
            paths[f"{split}_pinball_{q}"] = f"$.{split}_metrics.pinball_metrics.pinball_{q}"
        paths[f"{split}_coverage_80"] = f"$.{split}_metrics.coverage_80_interval"
    return paths


def normalize_naive_summary(summaries: DataFrame) -> DataFrame:
    name = P.variant_value(F.col("payload"), "$.model", "string", F.lit("seasonal_naive_weekly"))
    return _normalized(summaries, name, F.lit("SeasonalNaive"), _flat_paths())


def normalize_arma_summary(summaries: DataFrame) -> DataFrame:
    payload = F.col("payload")
    name = P.variant_value(payload, "$.selected_model_name", "string", F.lit("sarimax"))
    family = P.variant_value(payload, "$.model_family", "string", F.lit("SARIMAX"))
    return _normalized(summaries, name, family, _flat_paths())


def normalize_quantile_summary(summaries: DataFrame) -> DataFrame:
    payload = F.col("payload")
    name = P.variant_value(payload, "$.selected_model_name", "string", F.lit("quantile_gbr"))
    family = P.variant_value(
        payload, "$.model_family", "string", F.lit("GradientBoostingRegressor_Quantile")
    )
    return _normalized(summaries, name, family, _quantile_paths())


def _pick(split: str, column: str) -> Column:
    return F.max(F.when(F.col("split") == split, F.col(column)))


def _point_block(split: str) -> Column:
    return F.struct(_pick(split, "mae").alias("MAE"), _pick(split, "rmse").alias("RMSE"))


def point_summary(metrics: DataFrame, name: str, *, name_field: str = "model") -> DataFrame:
    """Summary document of a point model from its metrics per split."""
    blocks = [_point_block(s).alias(f"{s}_metrics") for s in ("validation", "test")]
    text = F.to_json(F.struct(F.lit(name).alias(name_field), *blocks))
    return metrics.agg(F.parse_json(text).alias("payload"))


def quantile_summary(metrics: DataFrame, name: str) -> DataFrame:
    """Summary document of a quantile model from its metric table per split."""
    blocks = []
    for s in ("validation", "test"):
        losses = [_pick(s, f"pinball_{q}").alias(f"pinball_{q}") for q in ("q10", "q50", "q90")]
        block = F.struct(
            _point_block(s).alias("point_metrics"),
            F.struct(*losses).alias("pinball_metrics"),
            _pick(s, "coverage_80").alias("coverage_80_interval"),
        )
        blocks.append(block.alias(f"{s}_metrics"))
    text = F.to_json(F.struct(F.lit(name).alias("selected_model_name"), *blocks))
    return metrics.agg(F.parse_json(text).alias("payload"))


def combine_metrics(*tables: DataFrame) -> DataFrame:
    """Metric tables of several models under each other; a column one lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def baseline_comparison(*normalized: DataFrame) -> DataFrame:
    """Normalised summaries of all models in one table, absent metrics NULL."""
    return combine_metrics(*normalized).select(*BASELINE_COLUMNS)


def ranked_baselines(comparison: DataFrame) -> DataFrame:
    return R.rank_by(comparison, "test_rmse", "model_name")


def best_point_model(comparison: DataFrame) -> DataFrame:
    return R.best_by(
        comparison, "test_rmse", "model_name",
        columns=("model_name", "model_family", "test_rmse", "test_mae"),
    )


def best_probabilistic_model(comparison: DataFrame) -> DataFrame:
    """Lowest test pinball loss of the median among the models that have one; none is an error."""
    best = F.min_by(
        F.struct("model_name", "model_family", "test_pinball_q50", "test_coverage_80"),
        F.when(
            F.col("test_pinball_q50").isNotNull(), F.struct("test_pinball_q50", "model_name")
        ),
    )
    found = comparison.agg(best.alias("_best"))
    checked = F.assert_true(F.col("_best").isNotNull(), "no model has probabilistic metrics")
    return found.withColumn("_ok", checked).where(F.col("_ok").isNull()).select("_best.*")


def baseline_interpretation(comparison: DataFrame) -> DataFrame:
    """Best models, calibration label and the summary sentence, as one row."""
    point = best_point_model(comparison).select(
        F.col("model_name").alias("best_point_forecast_model")
    )
    probabilistic = best_probabilistic_model(comparison).select(
        F.struct(F.col("model_name").alias("name"), "test_coverage_80").alias("_p")
    )
    label = P.calibration_label(F.col("_p.test_coverage_80"))
    sentence = F.format_string(
        BASELINE_SENTENCE,
        F.col("best_point_forecast_model"),
        F.col("_p.name"),
        F.coalesce(F.format_string("%.4f", F.col("_p.test_coverage_80")), F.lit("unknown")),
        label,
    )
    return point.withColumn("_p", probabilistic.scalar()).select(
        "best_point_forecast_model",
        F.col("_p.name").alias("best_probabilistic_model"),
        label.alias("interval_calibration_assessment"),
        sentence.alias("summary_statement"),
    )


def horizon_report(predictions: DataFrame, *, actual: str, by: Sequence[str] = ("horizon", "lead_steps", "model_name")) -> DataFrame:
    """One row per horizon and model with validation and test metrics side by side and a label."""
    metrics = metric_table(
        predictions.where(F.col("split").isin("validation", "test")), actual=actual, by=[*by, "split"]
    )
    names = ("mae", "rmse", "pinball_q10", "pinball_q50", "pinball_q90", "coverage_80")
    wide = metrics.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}")
            for s in ("validation", "test")
            for m in names
        ]
    )
    return wide.withColumn(
        "test_calibration_assessment", P.calibration_label(F.col("test_coverage_80"))
    )


def horizon_comparison(
    report: DataFrame, *, model_family: str, source_path: Column | None = None
) -> DataFrame:
    """The horizon report under its published column names and order."""
    source = F.lit(None).cast("string") if source_path is None else source_path
    return report.select(
        F.col("horizon").alias("horizon_label"),
        F.col("lead_steps").alias("lead_hours"),
        F.col("model_name").alias("selected_model_name"),
        F.lit(model_family).alias("model_family"),
        *_HORIZON_METRICS,
        source.alias("source_summary_path"),
        "test_calibration_assessment",
    )


def calibration_metrics(
    calibrated: DataFrame, *, actual: str, by: Sequence[str] = ("horizon", "split")
) -> DataFrame:
    """All measures of the raw and of the calibrated interval, one row each, from one pass."""
    bounds = {
        "raw": ("pred_q10", "pred_q90"),
        "calibrated": ("calibrated_lower", "calibrated_upper"),
    }
    versions = [
        F.struct(F.lit(k).alias("interval"), F.col(low).alias("pred_q10"), F.col(high).alias("pred_q90"))
        for k, (low, high) in bounds.items()
    ]
    stacked = calibrated.select(*by, actual, "pred_q50", F.inline(F.array(*versions)))
    return metric_table(stacked, actual=actual, by=[*by, "interval"])


def conformal_report(calibrated: DataFrame, *, actual: str) -> DataFrame:
    """Adjustment, coverage and width on the test rows before and after, one row per horizon."""
    test = calibrated.where((F.col("split") == "test") & F.col(actual).isNotNull())
    a, low, high = F.col(actual), F.col("calibrated_lower"), F.col("calibrated_upper")
    return test.groupBy(F.col("horizon").alias("horizon_label")).agg(
        F.max("adjustment").alias("conformal_adjustment_mw"),
        E.coverage(a, F.col("pred_q10"), F.col("pred_q90")).alias("test_raw_coverage_80"),
        E.coverage(a, low, high).alias("test_calibrated_coverage_80"),
        E.width(F.col("pred_q10"), F.col("pred_q90")).alias("test_raw_interval_width"),
        E.width(low, high).alias("test_calibrated_interval_width"),
        E.rmse(a, F.col("pred_q50")).alias("test_rmse_q50"),
    )


def best_and_worst_horizon(report: DataFrame) -> DataFrame:
    """The horizons with the lowest and the highest test RMSE, labelled ``best`` and ``worst``."""
    columns = ("horizon", "lead_steps", "test_rmse", "test_mae")
    best = R.best_by(report, "test_rmse", "horizon", columns=columns)
    worst = R.best_by(report, "test_rmse", "horizon", columns=columns, worst=True)
    return best.withColumn("place", F.lit("best")).unionByName(
        worst.withColumn("place", F.lit("worst"))
    )


def horizon_statement(report: DataFrame) -> DataFrame:
    """One sentence on the strongest and the weakest horizon and on interval calibration."""
    place = best_and_worst_horizon(report)

    def cell(which: str, column: str) -> Column:
        return F.max(F.when(F.col("place") == which, F.col(column)))

    labels = report.agg(F.array_sort(F.collect_set("test_calibration_assessment")).alias("labels"))
    sentence = F.format_string(
        "The strongest horizon is %s with test RMSE %.2f, the weakest is %s with test RMSE %.2f. "
        "The 80%% prediction intervals are %s.",
        F.col("best"), F.col("best_rmse"), F.col("worst"), F.col("worst_rmse"),
        F.array_join("labels", ", "),
    )
    return (
        place.agg(
            cell("best", "horizon").alias("best"),
            cell("best", "test_rmse").alias("best_rmse"),
            cell("worst", "horizon").alias("worst"),
            cell("worst", "test_rmse").alias("worst_rmse"),
        )
        .withColumn("labels", labels.scalar())
        .select(sentence.alias("summary_statement"))
    )


def model_horizon_rmse(summaries: DataFrame) -> DataFrame:
    """RMSE per model and horizon from summaries ``(model, payload)`` of any known shape.

    A document without horizons, and a horizon entry without a label or without any
    error value, fails the job.
    """
    horizons = F.try_variant_get("payload", "$.horizons", "array<variant>")
    absent = F.raise_error(F.concat(F.lit("no horizons in the summary of "), F.col("model")))
    entries = summaries.select(
        "model", F.explode(F.when(horizons.isNull(), absent.cast("array<variant>")).otherwise(horizons)).alias("entry")
    )
    entry = F.col("entry")
    return entries.select(
        P.first_present(entry, ["$.horizon_label"], "string", "horizon label missing").alias("horizon"),
        P.first_present(entry, P.RMSE_PATHS, "double", "no error value in a horizon entry").alias("rmse"),
        "model",
    )


def model_comparison(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """Horizon by model, with the best model and its error; rows and columns in text order."""
    pivoted = R.pivot_models(metrics, models)
    return R.add_best_model(pivoted, models).orderBy("horizon")


def rmse_by_horizon(metrics: DataFrame, order: Sequence[str] = HORIZON_ORDER) -> DataFrame:
    """Error by horizon and model in horizon order."""
    place = P.ordered_label(F.col("horizon"), order)
    return metrics.withColumn("horizon_order", place).orderBy("horizon_order", "model")


def coverage_by_horizon(summaries: DataFrame, order: Sequence[str] = HORIZON_ORDER) -> DataFrame:
    """Test coverage of the 80 % interval per horizon beside the nominal level.

    Input is ``(horizon, payload)``; either known place of the coverage value serves.
    """
    covered = P.first_present(F.col("payload"), P.COVERAGE_PATHS, "double", "no coverage value")
    return summaries.select(
        "horizon",
        P.ordered_label(F.col("horizon"), order).alias("horizon_order"),
        covered.alias("coverage"),
        F.lit(NOMINAL_COVERAGE).alias("nominal"),
    ).orderBy("horizon_order")


def forecast_window(
    predictions: DataFrame,
    *,
    ts: str,
    actual: str,
    n: int = 200,
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """Last n actuals with median and interval, numbered in time order."""
    columns = [*series_keys, ts, actual, "pred_q10", "pred_q50", "pred_q90"]
    checked = P.require_columns(predictions, columns).select(*columns)
    return R.last_rows(checked, n, ts=ts, series_keys=series_keys)
