"""Spark side of the registered queries.

``events`` plays the hourly feed: mean ``value`` per hour is the target, event
types are labels, users are many short series. Each query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import scalars as P
from tidegrid.functions.calendar import add_calendar_features
from tidegrid.models import seasonal_naive as N
from tidegrid.operators import audit as AU
from tidegrid.operators import grid as G
from tidegrid.operators import horizons as H
from tidegrid.operators import metrics as M
from tidegrid.models.least_squares import fit_least_squares
from tidegrid.operators import ranking as R
from tidegrid.operators import splits as S
from tidegrid.operators.chunks import add_row_number
from tidegrid.operators.conformal import conformal_adjustment, conformal_calibrate
from tidegrid.operators.features import add_history_features, resample_with_history
from tidegrid.operators.fill import drop_incomplete, impute_train_median, interpolate
from tidegrid.operators.order_stats import median
from tidegrid.plans import modeling as ML
from tidegrid.plans import reports as RP
from tidegrid.plans.walk_forward import fold_metrics, summarise_folds
from tidegrid.session import cut_lineage
from tidegrid.sources import documents as D
from tidegrid.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
TRAIN_END = "2024-01-14 23:00:00"
VALIDATION_END = "2024-01-20 23:00:00"
VALIDATION_START = "2024-01-15 00:00:00"
TEST_START = "2024-01-21 00:00:00"
FOLDS = S.RollingOrigin("2024-01-10 23:00:00", stride=72, horizon=168, folds=6)
# Fixed value: standard normal quantile at 0.9.
Z90 = 1.2815515655446004
MODELS = ("hourly_normal", "persistence", "trailing_day")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals for comparison across engines.

    The nudge moves exact halves, on which engines differ by their last bit, off
    the rounding edge; adding zero removes the sign of a zero.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round((F.col(c) + 1e-9) * 1e6) / 1e6 + 0.0 for c in doubles}) if doubles else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")


def truncated(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    return events(spark, sf_dir).withColumn("ts", F.date_trunc(unit, "ts").cast("timestamp_ntz"))


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly mean per event type on its own complete grid."""
    return G.resample_mean(
        events(spark, sf_dir), ts="ts", value="value", series_keys=["event_type"]
    )


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resample_mean(events(spark, sf_dir), ts="ts", value="value", series_keys=["user_id"])


def split_label(ts: Column | None = None, embargo: int = 0) -> Column:
    return S.half_open_split(
        F.col("ts") if ts is None else ts, at(TRAIN_END), at(VALIDATION_END), embargo=embargo
    )


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.build_supervised_table(
        by_type(spark, sf_dir), value="value", prefix="load", ts="ts", series_keys=["event_type"]
    )


def labelled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per origin and horizon with an available target, split by origin time."""
    wide = H.add_horizon_targets(
        by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"]
    )
    return S.add_split(H.available_rows(H.long_horizons(wide), "target_available"), split_label())


def normal_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic quantile forecasts: training mean and deviation by hour of the target.

    A single training row gives an interval without width; hours that train never saw have no forecast.
    """
    rows = labelled_targets(spark, sf_dir).withColumn("target_hour", F.hour("target_timestamp"))
    keys = ["horizon", "event_type", "target_hour"]
    fitted = (
        rows.where(F.col("split") == "train")
        .groupBy(*keys)
        .agg(F.avg("target").alias("pred_q50"), F.coalesce(F.stddev_samp("target"), F.lit(0.0)).alias("_spread"))
    )
    return (
        rows.join(fitted, keys)
        .select(
            "ts",
            "event_type",
            "horizon",
            "lead_steps",
            "split",
            "target",
            F.lit("hourly_normal").alias("model_name"),
            (F.col("pred_q50") - Z90 * F.col("_spread")).alias("pred_q10"),
            "pred_q50",
            (F.col("pred_q50") + Z90 * F.col("_spread")).alias("pred_q90"),
        )
    )


def collapse_duplicates(spark, sf_dir):
    return rounded(
        G.collapse_duplicates(
            truncated(spark, sf_dir, "minute"), ts="ts", value="value", series_keys=["event_type"]
        )
    )


def hourly_resample(spark, sf_dir):
    return rounded(G.resample_mean(events(spark, sf_dir), ts="ts", value="value"))


def grouped_resample(spark, sf_dir):
    return rounded(by_type(spark, sf_dir))


def user_resample(spark, sf_dir):
    return rounded(by_user(spark, sf_dir))


def half_hour_resample(spark, sf_dir):
    return rounded(
        G.resample_mean(
            events(spark, sf_dir), ts="ts", value="value", series_keys=["event_type"],
            step="30 minutes", start=at("2024-01-03 00:00:00"), end=at("2024-01-25 23:30:00"),
        )
    )


def grid_alignment(spark, sf_dir):
    observed = G.collapse_duplicates(
        truncated(spark, sf_dir), ts="ts", value="value", series_keys=["event_type"]
    )
    aligned = G.align_to_grid(
        observed, ts="ts", series_keys=["event_type"], start=at("2023-12-31 00:00:00"),
        end=at("2024-02-01 23:00:00"),
    )
    return rounded(aligned.withColumn("missing_flag", P.missing_flag(F.col("value"))))


def missing_timestamps(spark, sf_dir):
    return G.missing_timestamps(truncated(spark, sf_dir), ts="ts", series_keys=["event_type"])


def timestamp_difference(spark, sf_dir):
    hours = truncated(spark, sf_dir)
    users = hours.select("user_id", "ts")
    grid = G.build_grid(users, ts="ts", series_keys=["user_id"])
    return G.timestamp_difference(grid, users, ["user_id", "ts"])


def series_audit(spark, sf_dir):
    return AU.series_audit(
        truncated(spark, sf_dir), ts="ts", value="value", series_keys=["event_type"],
        start=at("2024-01-01 00:00:00"), end=at("2024-01-31 23:00:00"),
    )


def user_audit(spark, sf_dir):
    return AU.series_audit(by_user(spark, sf_dir), ts="ts", value="value", series_keys=["user_id"])


def label_profile(spark, sf_dir):
    sparse = by_type(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("event_type") != "error", F.col("event_type"))
    )
    return rounded(AU.label_profile(sparse, label="event_type", value="value"))


def coverage_profile(spark, sf_dir):
    flagged = by_user(spark, sf_dir).withColumn("available", P.available_flag(F.col("value")))
    return AU.coverage_profile(flagged, ts="ts", value="value", by=["user_id"], flags=["available"])


def distinct_labels(spark, sf_dir):
    return AU.distinct_labels(events(spark, sf_dir), "event_type")


def duplicate_count(spark, sf_dir):
    return AU.duplicate_count(truncated(spark, sf_dir), ["ts"], by=["event_type"])


def null_hours(spark, sf_dir):
    return AU.null_rows(by_type(spark, sf_dir), "value").select("event_type", "ts")


def wide_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per event type on the common hourly grid."""
    return widened(by_type(spark, sf_dir))


def widened(series: DataFrame) -> DataFrame:
    """The same from the hourly series of the types."""
    wide = (
        series
        .withColumn("event_type", R.listed("event_type", EVENT_TYPES))
        .groupBy("ts")
        .pivot("event_type", list(EVENT_TYPES))
        .agg(F.max("value"))
    )
    return G.align_to_grid(wide, ts="ts")


def filled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = P.add_missing_flags(wide_types(spark, sf_dir), EVENT_TYPES, "_missing_flag_raw")
    filled = interpolate(flagged, EVENT_TYPES, ts="ts", limit=ML.WEATHER_LIMIT, method="time")
    return P.add_missing_flags(filled, EVENT_TYPES, "_missing_flag_postfill")


def interpolate_columns(spark, sf_dir):
    return rounded(filled_types(spark, sf_dir))


def column_quality(spark, sf_dir):
    return AU.column_quality(filled_types(spark, sf_dir), EVENT_TYPES)


def interpolate_linear(spark, sf_dir):
    return rounded(
        interpolate(by_type(spark, sf_dir), "value", ts="ts", limit=3, series_keys=["event_type"])
    )


def interpolate_time(spark, sf_dir):
    return rounded(
        interpolate(
            by_user(spark, sf_dir), "value", ts="ts", limit=6, series_keys=["user_id"], method="time"
        )
    )


def interpolate_forward(spark, sf_dir):
    return rounded(
        interpolate(
            by_user(spark, sf_dir), "value", ts="ts", limit=3, series_keys=["user_id"],
            direction="forward",
        )
    )


def calendar_features(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return rounded(add_calendar_features(dated, "ts"))


def lag_features(spark, sf_dir):
    return rounded(
        add_history_features(
            by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"], rolling=()
        )
    )


def lag_features_sparse(spark, sf_dir):
    """Lags on observed hours only: a lag is a time, not a number of rows."""
    observed = by_user(spark, sf_dir).where(F.col("value").isNotNull())
    return rounded(
        add_history_features(observed, value="value", ts="ts", series_keys=["user_id"], rolling=())
    )


def rolling_features(spark, sf_dir):
    filled = interpolate(by_type(spark, sf_dir), "value", ts="ts", limit=3, series_keys=["event_type"])
    return rounded(
        add_history_features(filled, value="value", ts="ts", series_keys=["event_type"], lags=())
    )


def rolling_exclude_current(spark, sf_dir):
    filled = interpolate(by_type(spark, sf_dir), "value", ts="ts", limit=3, series_keys=["event_type"])
    return rounded(
        add_history_features(
            filled, value="value", ts="ts", series_keys=["event_type"], lags=(), exclude_current=True
        )
    )


def supplier_history(spark, sf_dir):
    """Many daily series: mean quantity per supplier with weekly history features."""
    shipped = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").alias("ts"), "l_quantity"
    )
    return rounded(
        resample_with_history(
            shipped, value="l_quantity", ts="ts", series_keys=["l_suppkey"], step="1 day",
            prefix="quantity", lags=(1, 7), rolling=(7,),
        )
    )


def modeling_table(spark, sf_dir):
    """Clicks as the target, views as the exogenous series."""
    series = by_type(spark, sf_dir)
    load = ML.prepare_load(
        series.where(F.col("event_type") == "click").select("ts", F.col("value").alias("load_mw")), ts="ts"
    )
    wind = ML.prepare_wind(
        series.select("ts", F.col("event_type").alias("psr_type"), F.col("value").alias("generation_mw")),
        ts="ts", label="view",
    )
    return rounded(ML.build_modeling_table(load, wind, ts="ts"))


def weather_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's series with the series of all types as weather-like columns, filled and flagged."""
    return ML.add_weather(
        by_type(spark, sf_dir), wide_types(spark, sf_dir), EVENT_TYPES, ts="ts", series_keys=["event_type"]
    )


def exogenous_join(spark, sf_dir):
    return rounded(weather_augmented(spark, sf_dir))


def weather_horizons(spark, sf_dir):
    """Weather-augmented rows with the targets of all horizons and their times."""
    return rounded(
        H.add_horizon_targets(
            weather_augmented(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"]
        )
    )


def run_lineage(spark, sf_dir):
    """Provenance of the hourly table, without its time stamp."""
    row = sinks.lineage_row(
        by_type(spark, sf_dir), ts="ts", source="events", parameters={"step": "1 hour"},
        url="https://feed.example/api?securityToken=TESTTOKEN&step=1h",
    )
    return row.select(
        "source", "resolved_url", "row_count", "start_utc", "end_utc",
        F.col("parameters")["step"].alias("step"), F.array_join("columns", ",").alias("columns"),
    )


def horizon_targets(spark, sf_dir):
    return rounded(
        H.add_horizon_targets(
            by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"]
        )
    )


def user_targets(spark, sf_dir):
    wide = H.add_horizon_targets(by_user(spark, sf_dir), value="value", ts="ts", series_keys=["user_id"])
    return H.horizon_summary(H.long_horizons(wide), "ts")


def supervised_table(spark, sf_dir):
    return rounded(supervised(spark, sf_dir))


def time_split(spark, sf_dir):
    return rounded(S.add_split(events(spark, sf_dir), split_label()))


def time_split_closed(spark, sf_dir):
    label = S.closed_split(
        F.col("ts"), at(TRAIN_END), at(VALIDATION_START), at(VALIDATION_END), at(TEST_START)
    )
    return rounded(S.add_split(events(spark, sf_dir), label))


def split_summary(spark, sf_dir):
    return S.split_summary(labelled_targets(spark, sf_dir), ts="ts", by=("horizon",))


def split_embargo(spark, sf_dir):
    wide = H.add_horizon_targets(
        by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"], horizons={"t_plus_24": 24}
    )
    available = H.available_rows(wide, "target_available_t_plus_24")
    return S.split_summary(S.add_split(available, split_label(embargo=24)), ts="ts", by=("event_type",))


def before_test(spark, sf_dir):
    return rounded(S.before_test(S.add_split(events(spark, sf_dir), split_label())))


def train_median(spark, sf_dir):
    train = S.add_split(events(spark, sf_dir), split_label()).where(F.col("split") == "train")
    return rounded(median(train, "value", keys=["event_type"]))


def train_median_impute(spark, sf_dir):
    featured = S.add_split(
        add_history_features(
            by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"],
            lags=(1, 24), rolling=(),
        ),
        split_label(),
    )
    filled = impute_train_median(featured, ["load_lag_1"])
    return rounded(drop_incomplete(filled, ["value", "load_lag_1", "load_lag_24"]))


def row_position(spark, sf_dir):
    known = AU.present_rows(by_user(spark, sf_dir), "value").select("user_id", "ts")
    return add_row_number(known, ts="ts", series_keys=["user_id"], name="position")


def known_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AU.present_rows(S.add_split(by_type(spark, sf_dir), split_label()), "value")


def seasonal_naive(spark, sf_dir):
    return rounded(
        N.seasonal_naive(known_split(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"])
    )


def seasonal_naive_time(spark, sf_dir):
    return rounded(
        N.seasonal_naive(
            known_split(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"], mode="time"
        )
    )


def naive_evaluation(spark, sf_dir):
    return rounded(
        N.evaluate_seasonal_naive(
            S.add_split(by_type(spark, sf_dir), split_label()), value="value", ts="ts",
            series_keys=["event_type"], strict=False,
        )
    )


def walk_forward_forecasts(spark, sf_dir):
    return rounded(
        N.walk_forward_naive(
            by_type(spark, sf_dir), FOLDS, value="value", ts="ts", series_keys=["event_type"], season=48
        )
    )


def walk_forward(spark, sf_dir):
    forecasts = N.walk_forward_naive(
        by_type(spark, sf_dir), FOLDS, value="value", ts="ts", series_keys=["event_type"], season=48
    )
    return rounded(summarise_folds(fold_metrics(forecasts, actual="value", by=["event_type"]), by=["event_type"]))


def point_metrics(spark, sf_dir):
    return rounded(
        M.point_metrics(
            normal_forecasts(spark, sf_dir), actual="target", forecast="pred_q50",
            by=["horizon", "event_type", "split"],
        )
    )


def metric_table(spark, sf_dir):
    return rounded(
        M.metric_table(
            normal_forecasts(spark, sf_dir), actual="target", by=["horizon", "model_name", "split"]
        )
    )


def interval_levels(spark, sf_dir):
    """Nominal 80 and 90 % intervals side by side."""
    half = (F.col("pred_q90") - F.col("pred_q50")) / Z90 * 1.6448536269514722
    wider = normal_forecasts(spark, sf_dir).withColumns(
        {"pred_q05": F.col("pred_q50") - half, "pred_q95": F.col("pred_q50") + half}
    )
    return rounded(
        M.interval_coverage_by_level(
            wider, actual="target", by=["horizon", "split"],
            intervals={80: ("pred_q10", "pred_q90"), 90: ("pred_q05", "pred_q95")},
        )
    )


def conformal_rank(spark, sf_dir):
    validation = normal_forecasts(spark, sf_dir).where(F.col("split") == "validation")
    return rounded(
        conformal_adjustment(
            validation, actual="target", keys=["horizon", "event_type"]
        )
    )


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformal_calibrate(
        normal_forecasts(spark, sf_dir), actual="target", keys=["horizon", "model_name"],
    )


def conformal_calibrate_intervals(spark, sf_dir):
    return rounded(
        calibrated(spark, sf_dir).select(
            "ts", "event_type", "horizon", "split", "adjustment", "calibrated_lower", "calibrated_upper"
        )
    )


def conformal_comparison(spark, sf_dir):
    return rounded(RP.conformal_report(calibrated(spark, sf_dir), actual="target"))


def calibration_metrics(spark, sf_dir):
    return rounded(RP.calibration_metrics(calibrated(spark, sf_dir), actual="target"))


def model_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic point forecasts per origin and horizon, one row per model."""
    keys = ["ts", "event_type"]
    history = add_history_features(
        by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"], lags=(), rolling=(24,)
    ).select(*keys, F.col("value").alias("persistence"), F.col("load_rollmean_24").alias("trailing_day"))
    rows = normal_forecasts(spark, sf_dir).withColumnRenamed("pred_q50", "hourly_normal")
    joined = G.join_on_time(rows, history, ts="ts", keys=["event_type"])
    stacked = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("forecast")) for m in sorted(MODELS)]
    )
    return joined.select("horizon", "lead_steps", "split", "target", F.explode(stacked).alias("f")).select(
        "horizon", "lead_steps", "split", "target", "f.*"
    )


def model_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = AU.present_rows(model_forecasts(spark, sf_dir).where(F.col("split") == "test"), "forecast")
    return M.point_metrics(scored, actual="target", forecast="forecast", by=["horizon", "model"]).select(
        "horizon", "model", "rmse"
    )


def model_pivot(spark, sf_dir):
    return rounded(R.pivot_models(model_rmse(spark, sf_dir), MODELS))


def best_model(spark, sf_dir):
    return rounded(RP.model_comparison(model_rmse(spark, sf_dir), MODELS))


def combined_metrics(spark, sf_dir):
    """Test metrics of a quantile model and of a point model, which lacks the quantile measures."""
    test = normal_forecasts(spark, sf_dir).where(F.col("split") == "test")
    quantile = M.metric_table(test, actual="target", by=["horizon", "model_name"])
    persistence = AU.present_rows(model_forecasts(spark, sf_dir), "forecast").where(
        (F.col("split") == "test") & (F.col("model") == "persistence")
    )
    point = M.point_metrics(persistence, actual="target", forecast="forecast", by=["horizon", "model"])
    return rounded(RP.combine_metrics(quantile, point.withColumnRenamed("model", "model_name")))


def best_model_per_horizon(spark, sf_dir):
    return rounded(
        R.best_by(model_rmse(spark, sf_dir), "rmse", "model", columns=["model", "rmse"], by=["horizon"])
    )


def rmse_by_horizon(spark, sf_dir):
    return rounded(RP.rmse_by_horizon(model_rmse(spark, sf_dir)))


def model_summaries(spark, sf_dir):
    """Summary documents of three known shapes, unified to one error value per horizon."""
    metrics = model_rmse(spark, sf_dir)
    flat = F.struct(F.col("horizon").alias("horizon_label"), F.col("rmse").alias("test_rmse"))
    short = F.struct(F.col("horizon").alias("horizon_label"), "rmse")
    nested = F.struct(
        F.col("horizon").alias("horizon_label"),
        F.struct(F.struct(F.col("rmse").alias("RMSE")).alias("point_metrics")).alias("test_metrics"),
    )
    entry = (
        F.when(F.col("model") == "hourly_normal", F.to_json(flat))
        .when(F.col("model") == "persistence", F.to_json(short))
        .otherwise(F.to_json(nested))
    )
    text = F.concat(F.lit('{"horizons":['), F.array_join(F.collect_list(entry), ","), F.lit("]}"))
    documents = metrics.groupBy("model").agg(F.parse_json(text).alias("payload"))
    return rounded(RP.model_horizon_rmse(documents))


def horizon_report(spark, sf_dir):
    return rounded(RP.horizon_report(normal_forecasts(spark, sf_dir), actual="target"))


def horizon_comparison(spark, sf_dir):
    report = RP.horizon_report(normal_forecasts(spark, sf_dir), actual="target")
    return rounded(
        RP.horizon_comparison(report, model_family="HourlyNormal", source_path=F.concat(F.lit("models/"), "horizon"))
    )


def best_and_worst_horizon(spark, sf_dir):
    report = RP.horizon_report(normal_forecasts(spark, sf_dir), actual="target")
    return rounded(RP.best_and_worst_horizon(report))


def horizon_statement(spark, sf_dir):
    return RP.horizon_statement(RP.horizon_report(normal_forecasts(spark, sf_dir), actual="target"))


def coverage_by_horizon(spark, sf_dir):
    """Coverage read back from summary documents of either shape."""
    covered = M.metric_table(
        normal_forecasts(spark, sf_dir).where(F.col("split") == "test"), actual="target", by=["horizon"]
    )
    nested = F.to_json(F.struct(F.struct(F.col("coverage_80").alias("coverage_80_interval")).alias("test_metrics")))
    flat = F.to_json(F.struct(F.col("coverage_80").alias("test_coverage_80_interval")))
    text = F.when(F.col("horizon") == "t_plus_1", flat).otherwise(nested)
    return rounded(RP.coverage_by_horizon(covered.select("horizon", F.parse_json(text).alias("payload"))))


def _comparisons(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Per horizon, summary documents of three baselines in their own shapes, read into one table.

    All horizons and models are measured in one aggregate each.
    """
    quantile = cut_lineage(M.metric_table(normal_forecasts(spark, sf_dir), actual="target", by=["horizon", "split"]))
    points = cut_lineage(M.point_metrics(
        AU.present_rows(model_forecasts(spark, sf_dir), "forecast"),
        actual="target", forecast="forecast", by=["horizon", "split", "model"],
    ))
    found = {}
    for horizon in H.HORIZONS:
        here = points.where(F.col("horizon") == horizon)
        naive = RP.point_summary(here.where(F.col("model") == "persistence"), "persistence")
        arma = RP.point_summary(
            here.where(F.col("model") == "trailing_day"), "trailing_day", name_field="selected_model_name"
        )
        losses = quantile.where(F.col("horizon") == horizon)
        found[horizon] = RP.baseline_comparison(
            RP.normalize_naive_summary(naive),
            RP.normalize_arma_summary(arma),
            RP.normalize_quantile_summary(RP.quantile_summary(losses, "hourly_normal")),
        )
    return found


def _of_every_horizon(spark: SparkSession, sf_dir: str, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    parts = [report(table).withColumn("horizon", F.lit(h)) for h, table in _comparisons(spark, sf_dir).items()]
    return reduce(DataFrame.unionByName, parts)


def baseline_report(spark, sf_dir):
    return rounded(_of_every_horizon(spark, sf_dir, RP.ranked_baselines))


def baseline_interpretation(spark, sf_dir):
    return _of_every_horizon(spark, sf_dir, RP.baseline_interpretation)


def last_n(spark, sf_dir):
    return rounded(
        RP.forecast_window(
            normal_forecasts(spark, sf_dir), ts="ts", actual="target", n=200, series_keys=["event_type", "horizon"],
        )
    )


def last_n_overall(spark, sf_dir):
    hourly = G.resample_mean(events(spark, sf_dir), ts="ts", value="value")
    return rounded(R.last_rows(hourly, 200, ts="ts"))


RESOLUTION_OF_FLAG = {"A": "PT15M", "N": "PT30M", "R": "PT60M"}


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as feed points: ship date is the period, line number the position."""
    token = F.coalesce(*[F.when(F.col("l_returnflag") == f, F.lit(t)) for f, t in RESOLUTION_OF_FLAG.items()])
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm'Z'").alias("period_start"),
        token.alias("resolution"),
        F.col("l_linenumber").alias("position"),
        F.col("l_quantity").alias("quantity"),
    )


def position_to_timestamp(spark, sf_dir):
    rebuilt = P.add_point_timestamps(raw_points(spark, sf_dir))
    return rebuilt.select(
        "l_orderkey", "l_linenumber", F.col("timestamp_utc").cast("timestamp_ntz").alias("ts"), "quantity"
    )


def resolution_minutes(spark, sf_dir):
    minutes = P.resolution_minutes(F.col("resolution"))
    return raw_points(spark, sf_dir).groupBy("resolution", minutes.alias("minutes")).agg(
        F.count(F.lit(1)).alias("points")
    )


def points_to_hourly(spark, sf_dir):
    """Points to hourly series per type and business label, missing types labelled explicitly."""
    points = P.add_point_timestamps(
        raw_points(spark, sf_dir)
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
              F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("psr_type", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
        .withColumn("business_type", F.when(F.col("o_orderpriority") != "5-LOW", F.substring("o_orderpriority", 1, 1)))
    ).withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp_ntz"))
    return rounded(ML.hourly_generation(points))


def redact_url(spark, sf_dir):
    token = F.concat(F.col("url"), F.lit("?securityToken=TEST"), F.col("page_id"), F.lit("&page=1"))
    return table(spark, sf_dir, "pages").select("page_id", P.redact_token(token).alias("url"))


def text_to_number(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        P.text_to_int(F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1), F.lit(" "))).alias("priority"),
        P.to_number(F.substr("o_orderpriority", F.lit(3))).alias("bad_number"),
        P.to_number(F.col("o_orderkey").cast("string")).alias("good_number"),
        P.parse_utc(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("parsed"),
        P.label_or_unknown(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))).alias("status"),
    )


def json_hour_map(spark, sf_dir):
    """Hourly JSON documents, one per day, built from the events and read back."""
    hourly = by_type(spark, sf_dir).withColumns(
        {"day": F.to_date("ts"), "hour_key": F.date_format("ts", "yyyyMMddHH")}
    )
    known = AU.present_rows(hourly, "value")
    variables = known.groupBy("day", "event_type").agg(
        F.to_json(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("hour_key", "value"))))
        ).alias("hours")
    )
    member = F.format_string('"%s":%s', F.col("event_type"), F.col("hours"))
    documents = variables.groupBy("day").agg(
        F.concat(
            F.lit('{"properties":{"parameter":{'),
            F.array_join(F.array_sort(F.collect_list(member)), ","),
            F.lit("}}}"),
        ).alias("content")
    )
    parsed = D.parse_hour_json(documents, variables={t: t for t in EVENT_TYPES}, ts="ts")
    return rounded(parsed.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-series documents, one per day, built from the events."""
    points = truncated(spark, sf_dir).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    hourly = points.groupBy("day", "event_type", "ts").agg(F.count(F.lit(1)).alias("n"))
    point = F.format_string(
        "<Point><position>%d</position><quantity>%d</quantity></Point>", F.hour("ts") + 1, F.col("n")
    )
    series = hourly.groupBy("day", "event_type").agg(F.array_join(F.collect_list(point), "").alias("points"))
    block = F.format_string(
        "<TimeSeries><businessType>A01</businessType><MktPSRType><psrType>%s</psrType></MktPSRType>"
        "<Period><timeInterval><start>%s</start></timeInterval><resolution>PT60M</resolution>%s</Period></TimeSeries>",
        F.col("event_type"), F.date_format("day", "yyyy-MM-dd'T'HH:mm'Z'"), F.col("points"),
    )
    return series.groupBy("day").agg(
        F.concat(
            F.lit('<Doc xmlns="urn:example:1">'),
            F.array_join(F.array_sort(F.collect_list(block)), ""),
            F.lit("</Doc>"),
        ).alias("content")
    )


def xml_point_rows(documents: DataFrame) -> DataFrame:
    parsed = P.add_point_timestamps(D.parse_series_xml(documents, dataset_name="events"))
    return parsed.select(
        "dataset_name", "series_index", "business_type", "psr_type", "resolution", "position", "quantity",
        F.col("timestamp_utc").cast("timestamp_ntz").alias("ts"),
    )


def xml_points(spark, sf_dir):
    """The documents' points with their times."""
    return xml_point_rows(xml_documents(spark, sf_dir))


def least_squares_fit(spark, sf_dir):
    """Value on hour of day and user number, per event type."""
    rows = table(spark, sf_dir, "events").select(
        "event_type", "value", F.hour("ts").cast("double").alias("x1"), F.col("user_id").cast("double").alias("x2")
    )
    fitted = fit_least_squares(rows, y="value", x=["x1", "x2"], keys=["event_type"])
    b = F.col("coefficients")
    return rounded(fitted.select("event_type", "n", b[0].alias("b0"), b[1].alias("b1"), b[2].alias("b2"), "rss"))


def boost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type's filled series with calendar, history, targets, split, views as the exogenous series and two weather columns.

    The hourly series is stored once: five branches start from it, and each would read the events again.
    """
    series = cut_lineage(by_type(spark, sf_dir))
    filled = interpolate(series, "value", ts="ts", limit=3, series_keys=["event_type"])
    wind = ML.prepare_wind(
        series.select("ts", F.col("event_type").alias("psr_type"), F.col("value").alias("generation_mw")), ts="ts", label="view"
    )
    joined = add_calendar_features(G.join_on_time(filled, wind, ts="ts"), "ts")
    weather = ML.add_weather(
        cut_lineage(joined), widened(series).select("ts", "purchase", "signup"), ["purchase", "signup"], ts="ts", series_keys=["event_type"]
    )
    featured = ML.build_supervised_table(weather, value="value", prefix="load", ts="ts", series_keys=["event_type"])
    return S.add_split(featured, split_label())


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        collapse_duplicates, hourly_resample, grouped_resample, user_resample, half_hour_resample,
        grid_alignment, missing_timestamps, timestamp_difference, series_audit, user_audit,
        label_profile, coverage_profile, distinct_labels, duplicate_count, null_hours,
        interpolate_columns, column_quality, interpolate_linear, interpolate_time,
        interpolate_forward, calendar_features, lag_features, rolling_features,
        rolling_exclude_current, supplier_history, modeling_table, exogenous_join, weather_horizons, run_lineage,
        horizon_targets,
        user_targets, supervised_table, time_split, time_split_closed, split_summary,
        split_embargo, before_test, train_median, train_median_impute, row_position,
        seasonal_naive, seasonal_naive_time, naive_evaluation, walk_forward_forecasts,
        walk_forward, point_metrics, metric_table, interval_levels, conformal_rank,
        conformal_calibrate_intervals, conformal_comparison, calibration_metrics, model_pivot, best_model,
        combined_metrics, best_model_per_horizon, rmse_by_horizon, model_summaries, horizon_report,
        horizon_comparison, best_and_worst_horizon, horizon_statement, coverage_by_horizon, baseline_report,
        baseline_interpretation, last_n, last_n_overall, position_to_timestamp,
        resolution_minutes, points_to_hourly, redact_url, text_to_number, json_hour_map,
        least_squares_fit, lag_features_sparse, xml_points,
    )
}
