import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import scalars as P
from tidegrid.operators import audit as AU
from tidegrid.operators import horizons as H
from tidegrid.operators import metrics as M
from tidegrid.operators import ranking as R
from tidegrid.operators import splits as S
from tidegrid.plans import reports as RP


def documents(spark, payloads, name="horizon"):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads], f"{name} string, text string")
    return df.select(name, F.parse_json("text").alias("payload"))


def test_metric_fixtures(spark):
    df = spark.createDataFrame(
        [(10.0, 8.0, 8.0, 8.0), (None, 1.0, 1.0, 1.0)], "y double, pred_q10 double, pred_q50 double, pred_q90 double"
    )
    row = M.metric_table(df, actual="y").first()
    assert row.row_count == 1 and row.pinball_q90 == pytest.approx(1.8) and row.mae == 2.0
    rows = [(1.0, 1.0, 2.0), (2.0, 1.0, 2.0), (1.5, 2.0, 1.0), (1.5, None, 2.0)]
    bounds = spark.createDataFrame(rows, "y double, lo double, hi double")
    out = M.interval_coverage_by_level(bounds, actual="y", intervals={80: ("lo", "hi")}).first()
    assert (out.nominal, out.coverage) == (0.8, 0.5)


def test_split_edges(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 30),)], "ts timestamp_ntz")
    t = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-01 23:00:00", "2024-01-02 00:00:00", "2024-01-02 23:00:00", "2024-01-03 00:00:00")]
    assert S.add_split(df, S.closed_split(F.col("ts"), *t)).count() == 0
    assert S.add_split(df, S.half_open_split(F.col("ts"), t[0], t[2])).first().split == "validation"


def test_embargo_drops_crossing_targets(hourly):
    train_end = F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")
    validation_end = F.lit("2024-01-01 19:00:00").cast("timestamp_ntz")
    df = hourly([1.0] * 30)
    label = S.half_open_split(F.col("ts"), train_end, validation_end, embargo=3)
    counts = {r.split: r["count"] for r in S.add_split(df, label).groupBy("split").count().collect()}
    assert counts == {"train": 7, "validation": 7, "test": 10}


def test_best_model_ties_and_nulls(spark):
    rows = [("h1", "GBR", 2.0), ("h1", "GBR_weather", 2.0), ("h1", "Deep", None), ("h2", "Deep", 1.0), ("h2", "GBR", 3.0)]
    df = spark.createDataFrame(rows, "horizon string, model string, rmse double")
    models = ["GBR_weather", "GBR", "Deep"]
    out = {r.horizon: r for r in RP.model_comparison(df, models).collect()}
    assert list(out["h1"].asDict()) == ["horizon", "Deep", "GBR", "GBR_weather", "best_model", "best_rmse"]
    assert (out["h1"].best_model, out["h1"].best_rmse) == ("GBR", 2.0)
    assert (out["h2"].best_model, out["h2"].GBR_weather) == ("Deep", None)


def test_text_errors_are_coerced(spark):
    df = spark.createDataFrame([("h1", "2.5", "oops"), ("h2", "9", "3")], "horizon string, a string, b string")
    out = {r.horizon: r for r in R.add_best_model(df, ["a", "b"]).collect()}
    assert (out["h1"].best_model, out["h1"].b) == ("a", None)
    assert (out["h2"].best_model, out["h2"].best_rmse) == ("b", 3.0)


def test_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([("h", "m", 1.0), ("h", "m", 2.0)], "horizon string, model string, rmse double")
    with pytest.raises(Exception, match="duplicate entries"):
        R.pivot_models(df, ["m"]).collect()


def test_published_comparison_order(spark):
    # Published test errors of three models.
    rows = [
        ("t_plus_1", "DeepAR_weather", 609.8781376537676), ("t_plus_1", "GBR", 174.5878988686797),
        ("t_plus_1", "GBR_weather", 166.47860682140762), ("t_plus_24", "DeepAR_weather", 602.2993082346537),
        ("t_plus_24", "GBR", 238.993026823652), ("t_plus_24", "GBR_weather", 232.42144669650688),
        ("t_plus_168", "DeepAR_weather", 535.5964446203311), ("t_plus_168", "GBR", 510.7549262773795),
        ("t_plus_168", "GBR_weather", 455.77503815525597),
    ]
    df = spark.createDataFrame(rows, "horizon string, model string, rmse double")
    out = RP.model_comparison(df, ["GBR", "GBR_weather", "DeepAR_weather"]).collect()
    assert [r.horizon for r in out] == ["t_plus_1", "t_plus_168", "t_plus_24"]
    assert {r.best_model for r in out} == {"GBR_weather"}
    assert [r.horizon for r in RP.rmse_by_horizon(df).collect()][::3] == ["t_plus_1", "t_plus_24", "t_plus_168"]


def test_first_present_paths(spark):
    entries = [
        {"horizon_label": "a", "rmse": 2.0},
        {"horizon_label": "b", "test_rmse": 1.0, "rmse": 9.0},
        {"horizon_label": "c", "test_metrics": {"point_metrics": {"RMSE": 3.0}}},
        {"horizon_label": "d", "validation_metrics": {"point_metrics": {"RMSE": 4.0}}},
        {"horizon_label": "e", "test_error": 5},
    ]
    df = documents(spark, [("m", {"horizons": entries})], "model")
    out = {r.horizon: r.rmse for r in RP.model_horizon_rmse(df).collect()}
    assert out == {"a": 2.0, "b": 1.0, "c": 3.0, "d": 4.0, "e": 5.0}
    for broken, message in (({"horizon_label": "x"}, "no error value"), ({"rmse": 1.0}, "label missing")):
        with pytest.raises(Exception, match=message):
            RP.model_horizon_rmse(documents(spark, [("m", {"horizons": [broken]})], "model")).collect()


def test_coverage_paths_and_order(spark):
    df = documents(spark, [
        ("t_plus_168", {"test_coverage_80_interval": 0.7}),
        ("t_plus_1", {"test_metrics": {"coverage_80_interval": 0.8}}),
    ])
    out = [(r.horizon, r.coverage, r.nominal) for r in RP.coverage_by_horizon(df).collect()]
    assert out == [("t_plus_1", 0.8, 0.8), ("t_plus_168", 0.7, 0.8)]


def test_calibration_labels(spark):
    df = spark.createDataFrame([(c,) for c in (0.7499, 0.75, 0.85, 0.8501, None)], "c double")
    assert [r[0] for r in df.select(P.calibration_label(F.col("c"))).collect()] == [
        "under-covered", "reasonably calibrated", "reasonably calibrated", "over-covered", "inconclusive",
    ]


# Published summaries of three baselines, rounded.
NAIVE = {"model": "seasonal_naive_weekly", "validation_metrics": {"MAE": 141.46, "RMSE": 191.12}, "test_metrics": {"MAE": 236.90, "RMSE": 316.51}}
ARMA = {"selected_model_name": "sarimax_101_101_24", "validation_metrics": {"MAE": 254.20, "RMSE": 326.32}, "test_metrics": {"MAE": 325.90, "RMSE": 389.85}}
BOOST = {
    "selected_model_name": "gbr_deeper",
    "validation_metrics": {"point_metrics": {"MAE": 62.0, "RMSE": 85.25}, "pinball_metrics": {"pinball_q10": 14.67, "pinball_q50": 31.0, "pinball_q90": 15.65}, "coverage_80_interval": 0.7249},
    "test_metrics": {"point_metrics": {"MAE": 90.25, "RMSE": 121.98}, "pinball_metrics": {"pinball_q10": 20.99, "pinball_q50": 45.12, "pinball_q90": 20.40}, "coverage_80_interval": 0.6887},
}


def comparison(spark, boost=BOOST):
    return RP.baseline_comparison(
        RP.normalize_naive_summary(documents(spark, [("n", NAIVE)])),
        RP.normalize_arma_summary(documents(spark, [("a", ARMA)])),
        RP.normalize_quantile_summary(documents(spark, [("q", boost)])),
    )


def test_baseline_report(spark):
    table = comparison(spark)
    assert tuple(table.columns) == RP.BASELINE_COLUMNS
    ranked = RP.ranked_baselines(table).collect()
    assert [r.model_name for r in ranked] == ["gbr_deeper", "seasonal_naive_weekly", "sarimax_101_101_24"]
    assert ranked[0].test_pinball_q50 == 45.12 and ranked[1].test_pinball_q50 is None
    row = RP.baseline_interpretation(table).first()
    assert row.interval_calibration_assessment == "under-covered"
    assert row.summary_statement == (
        "The strongest current point-forecast baseline is gbr_deeper, and the strongest probabilistic "
        "baseline is gbr_deeper. The observed 80% interval coverage is 0.6887, which is under-covered "
        "relative to the nominal target."
    )


def test_no_probabilistic_model_is_an_error(spark):
    with pytest.raises(Exception, match="no model has probabilistic metrics"):
        RP.best_probabilistic_model(comparison(spark, {"selected_model_name": "x"})).collect()


def test_last_rows(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), float(h)) for h in range(10)]
    df = spark.createDataFrame(rows, "s string, ts timestamp_ntz, y double")
    for keys in ((), ("s",)):
        out = R.last_rows(df, 3, ts="ts", series_keys=keys).orderBy("ts").collect()
        assert [(r.y, r.sequence) for r in out] == [(7.0, 0), (8.0, 1), (9.0, 2)]


def test_forecast_window_requires_columns(spark):
    df = spark.createDataFrame([(1,)], "ts int")
    with pytest.raises(ValueError, match="pred_q10"):
        RP.forecast_window(df, ts="ts", actual="ts")


def test_column_helpers(spark):
    df = spark.createDataFrame([(1,)], "load_target_t_plus_1 int")
    assert P.column_with_prefix(df, "load_target_") == "load_target_t_plus_1"
    with pytest.raises(ValueError):
        P.column_with_prefix(df, "other_")
    assert P.ensure_columns(df, {"x": "double"}).dtypes[-1] == ("x", "double")
    assert P.add_constants(df, model_name="m").first().model_name == "m"


def test_audit_with_duplicates_and_null_keys(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t, 1.0), (t, 2.0), (t + dt.timedelta(hours=2), None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, y double")
    row = AU.series_audit(df, ts="ts", value="y").first()
    assert (row.expected_count, row.observed_count, row.missing_count, row.null_count, row.duplicate_count) == (3, 3, 1, 1, 1)
    nulls = spark.createDataFrame([(None,), (None,), (t,)], "ts timestamp_ntz")
    assert AU.duplicate_count(nulls, ["ts"]).first().duplicate_count == 1


def test_horizon_leads(hourly):
    wide = H.add_horizon_targets(hourly([1.0, 2.0, None, 4.0]), value="y", ts="ts", series_keys=[], horizons={"t_plus_1": 1, "t_plus_2": 2}, rows=2)
    rows = wide.orderBy("ts").collect()
    assert [r.load_target_t_plus_1 for r in rows] == [2.0, None, 4.0, None]
    assert [r.target_available_t_plus_2 for r in rows] == [0, 1, 0, 0]
    assert rows[3].target_timestamp_t_plus_1 is None and rows[1].target_timestamp_t_plus_2 == rows[3].ts


def test_series_audit_equals_a_loop(spark):
    """Repeated, off-grid and NULL times, and rows outside of the range."""
    rng = np.random.default_rng(8)
    start = dt.datetime(2023, 12, 30)
    times = [start + dt.timedelta(hours=int(h), minutes=int(m)) for h, m in zip(rng.integers(0, 400, 500), rng.choice([0, 0, 0, 30], 500))]
    rows = [("a", t, None if k % 7 == 0 else 1.0) for k, t in enumerate(times)] + [("a", None, 1.0)] * 2
    low, high = start + dt.timedelta(hours=20), start + dt.timedelta(hours=300)
    row = AU.series_audit(
        spark.createDataFrame(rows, "s string, ts timestamp_ntz, y double"), ts="ts", value="y", series_keys=["s"],
        start=F.lit(low), end=F.lit(high),
    ).first()
    inside = {t for t in times if low <= t <= high and t.minute == 0}
    assert (row.expected_count, row.observed_count, row.missing_count) == (281, 502, 281 - len(inside))
    assert (row.null_count, row.duplicate_count) == (72, 502 - len(set(times)) - 1)
    assert (row.start_utc, row.end_utc) == (min(times), max(times))


def test_an_audit_of_a_grid_groups_by_many_steps(spark):
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], "s string, ts timestamp_ntz, y double")
    out = AU.series_audit(df, ts="ts", value="y", series_keys=["s"])
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "_word" in plan and "bit_or" in plan
