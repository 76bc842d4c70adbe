"""Queries of fitted models: results as they are, and what SQL can state about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from catalog import spark_queries as Q
from tidegrid.models import quantile_boost as B
from tidegrid.models import seasonal_arma as A
from tidegrid.operators import horizons as H
from tidegrid.operators import metrics as M
from tidegrid.operators.features import add_history_features
from tidegrid.plans import reports as RP
from tidegrid.plans.walk_forward import fold_metrics, summarise_folds, walk_forward_least_squares
from tidegrid.session import cut_lineage
from tidegrid.sources.constants import MODEL_FEATURES
from tidegrid.operators.conformal import conformal_calibrate

WEATHER = ("purchase", "signup")
WEATHER_FEATURES = (*MODEL_FEATURES, *WEATHER, *(f"{c}_missing_flag_postfill" for c in WEATHER))


def quantile_boost(spark, sf_dir):
    """Candidate search, refit and test predictions of all horizons, on all event types."""
    return B.train_horizons(
        Q.boost_table(spark, sf_dir), labels=list(H.HORIZONS), features=MODEL_FEATURES, keep=["event_type", "ts"],
        impute=["load_rollstd_24"],
    )


def _searched(table, features):
    return B.score_horizons(
        table, horizons=H.HORIZONS, features=features, keep=["event_type", "ts"], impute=["load_rollstd_24"]
    )


def candidate_table(spark, sf_dir):
    """Validation metrics of every candidate and horizon, with the chosen one marked."""
    return _searched(Q.boost_table(spark, sf_dir), MODEL_FEATURES)[1].drop("feature_set")


def boost_horizon_report(spark, sf_dir):
    """All horizons: candidates searched, intervals calibrated on validation, both splits reported side by side."""
    predictions, _ = _searched(Q.boost_table(spark, sf_dir), MODEL_FEATURES)
    calibrated = conformal_calibrate(predictions, actual="actual_target_mw", keys=["horizon"]).withColumns(
        {"pred_q10": F.col("calibrated_lower"), "pred_q90": F.col("calibrated_upper")}
    )
    by = ("horizon", "lead_steps", "model_name")
    raw = RP.horizon_report(predictions, actual="actual_target_mw", by=by)
    after = RP.horizon_report(calibrated, actual="actual_target_mw", by=by)
    return raw.join(after.select(*by, F.col("test_coverage_80").alias("calibrated_coverage_80")), list(by))


def boost_weather(spark, sf_dir):
    """Plain and weather-augmented models of every horizon, reported side by side."""
    predictions, _ = _searched(Q.boost_table(spark, sf_dir), {"plain": MODEL_FEATURES, "weather": WEATHER_FEATURES})
    return RP.horizon_report(predictions, actual="actual_target_mw", by=("horizon", "lead_steps", "feature_set", "model_name"))


def boost_checks(spark, sf_dir):
    """Per horizon and feature set: candidates, the chosen one, predicted rows, and the loss against a constant forecast."""
    featured = cut_lineage(Q.boost_table(spark, sf_dir))
    predictions, table = _searched(featured, {"plain": MODEL_FEATURES, "weather": WEATHER_FEATURES})
    by = ["horizon", "feature_set"]
    complete = [F.col(f"pred_{q}").isNotNull() for q in ("q10", "q50", "q90")]
    rows = predictions.groupBy(*by).agg(
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        F.count_if(complete[0] & complete[1] & complete[2]).alias("predicted_rows"),
    )
    known = H.long_horizons(featured).where("target IS NOT NULL")
    usual = known.where("split = 'train'").groupBy("horizon").agg(F.percentile_approx("target", 0.5, 100_000).alias("_usual"))
    constant = M.metric_table(
        known.where("split = 'test'").join(usual, "horizon").withColumns({c: F.col("_usual") for c in M.QUANTILES}), actual="target", by=["horizon"]
    ).select("horizon", F.col("pinball_q50").alias("_constant"))
    loss = M.metric_table(predictions.where("split = 'test'"), actual="actual_target_mw", by=by).select(
        *by, *[F.col(f"pinball_{q}").alias(f"_{q}") for q in ("q10", "q50", "q90")]
    )
    # Slack for noise: the feed of the test tables has no signal to learn.
    fits = F.col("_q50") < 1.25 * F.col("_constant")
    picked = table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if("selected").alias("chosen"),
        (F.min("pinball_q50") == F.max(F.when(F.col("selected"), F.col("pinball_q50")))).alias("least_loss_chosen"),
    )
    return rows.join(picked, by).join(loss, by).join(constant, "horizon").select(
        *by, "validation_rows", "test_rows", "predicted_rows", "candidates", "chosen", "least_loss_chosen", fits.alias("near_or_below_constant")
    )


STUMP = {"name": "stump", "n_estimators": 1, "learning_rate": 0.5, "max_depth": 1, "min_samples_leaf": 1, "subsample": 1.0}


def boost_stump(spark, sf_dir):
    """One round on one two-valued feature: the base and each leaf's step are lower quantiles."""
    rows = Q.events(spark, sf_dir).where("value IS NOT NULL").select(
        "value", (F.col("event_type") == "view").cast("double").alias("is_view")
    )
    models = B.fit_candidates(rows, target="value", features=["is_view"], candidates=[STUMP])[0]
    scored = B.predict_quantiles(rows, models)
    return Q.rounded(scored.groupBy("is_view").agg(F.count(F.lit(1)).alias("row_count"), *[F.max(q).alias(q) for q in models]))


def seasonal_arma(spark, sf_dir):
    """Order search on validation, then forecasts of the test span, per event type."""
    series = Q.S.add_split(Q.by_type(spark, sf_dir), Q.split_label())
    options = {"value": "value", "ts": "ts", "series_keys": ["event_type"]}
    best, _ = A.search_orders(series, **options)
    return A.refit_and_score_test(series, best, **options)


def arma_candidates(spark, sf_dir):
    """Validation metrics and AIC of every order."""
    series = Q.S.add_split(Q.by_type(spark, sf_dir), Q.split_label())
    return A.search_orders(series, value="value", ts="ts", series_keys=["event_type"])[1]


def arma_checks(spark, sf_dir):
    """Test rows, forecasts and span of the chosen order, per event type."""
    return seasonal_arma(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("forecast").alias("forecasts"), F.countDistinct("model_name").alias("models"),
        F.min("ts").alias("start_utc"), F.max("ts").alias("end_utc"),
    )


ARMA_ORDER, ARMA_SEASONAL = (1, 0, 1), (1, 0, 0, 24)
ARMA_COEFFICIENTS = (9.0, 0.4, 0.3, -0.12, 0.25)  # constant, lags 1, 24, 25, shock at lag 1


def arma_path(spark, sf_dir):
    """Recursive forecasts of 100 hours from given coefficients; shocks are the last change of the filled series."""
    filled = Q.interpolate(Q.by_type(spark, sf_dir), "value", ts="ts", limit=1000, series_keys=["event_type"])
    states = add_history_features(filled, value="value", ts="ts", series_keys=["event_type"], lags=(1,), rolling=()).select(
        "event_type", "ts", "value", F.col("value").alias("_z"), (F.col("value") - F.col("load_lag_1")).alias("_e")
    )
    fits = states.select("event_type").distinct().withColumn("coefficients", F.array(*map(F.lit, ARMA_COEFFICIENTS)))
    return Q.rounded(A.forecast_seasonal_arma(
        fits, states, value="value", ts="ts", order=ARMA_ORDER, seasonal_order=ARMA_SEASONAL, steps=100, series_keys=["event_type"]
    ))


def walk_forward_fitted(spark, sf_dir):
    """Six expanding-window fits on the value a week back, scored per fold and summarised."""
    lagged = add_history_features(Q.by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"], lags=(168,), rolling=())
    forecasts = walk_forward_least_squares(lagged, Q.FOLDS, y="value", x=["load_lag_168"], ts="ts", series_keys=["event_type"])
    per_fold = fold_metrics(forecasts, actual="value", by=["event_type"])
    return Q.rounded(summarise_folds(per_fold, by=["event_type"]))


def walk_forward_fitted_folds(spark, sf_dir):
    """The same forecasts, one row per event type and fold."""
    lagged = add_history_features(Q.by_type(spark, sf_dir), value="value", ts="ts", series_keys=["event_type"], lags=(168,), rolling=())
    forecasts = walk_forward_least_squares(lagged, Q.FOLDS, y="value", x=["load_lag_168"], ts="ts", series_keys=["event_type"])
    return Q.rounded(fold_metrics(forecasts, actual="value", by=["event_type"]))


QUERIES = {
    f.__name__: f
    for f in (
        quantile_boost, candidate_table, boost_horizon_report, boost_weather, boost_checks, boost_stump, seasonal_arma,
        arma_candidates, arma_checks, arma_path, walk_forward_fitted, walk_forward_fitted_folds,
    )
}

_b0, _b1, _b24, _b25, _m1 = ARMA_COEFFICIENTS
_FOLD_CTES = f"""{O.SERIES},
    lg AS (SELECT *, lag(value, 168) OVER {O.TYPE_ORDER} AS x FROM series),
    specs AS (SELECT * FROM (VALUES {', '.join(f'({k}, {origin})' for k, origin in O.FOLD_SPECS)}) s(fold, origin)),
    fit AS (SELECT event_type, fold, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM lg JOIN specs ON ts <= origin
        WHERE value IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 2),
    wf AS (SELECT l.event_type, s.fold::INTEGER AS fold, l.value, a + b * l.x AS forecast FROM lg l
        JOIN specs s ON l.ts > s.origin AND l.ts <= s.origin + INTERVAL 168 HOUR
        LEFT JOIN fit f ON f.event_type = l.event_type AND f.fold = s.fold),
    pf AS (SELECT event_type, fold, count(forecast) AS row_count, avg(abs(value - forecast)) AS mae,
        sqrt(avg((value - forecast) * (value - forecast))) AS rmse, count(*) - count(forecast) AS unscored_count
        FROM wf WHERE value IS NOT NULL GROUP BY 1, 2)"""
_BOOST = f"""{O.SERIES},
    {O.interpolated('series', 'fl', 'event_type', 3, 'linear').strip()},
    wv AS (SELECT 'view' AS event_type, ts, value FROM series WHERE event_type = 'view'),
    {O.interpolated('wv', 'wf', 'event_type', 3, 'linear').strip()},
    {O.interpolated('(SELECT s.event_type, s.ts, p.value FROM fl s LEFT JOIN series p ON p.ts = s.ts AND p.event_type = ' + "'purchase')", 'pf', 'event_type', 6, 'time').strip()},
    {O.interpolated('(SELECT s.event_type, s.ts, p.value FROM fl s LEFT JOIN series p ON p.ts = s.ts AND p.event_type = ' + "'signup')", 'sf', 'event_type', 6, 'time').strip()},
    ft AS (SELECT f.event_type, f.ts, f.value, w.value AS wind, p.value AS purchase, g.value AS signup FROM fl f
        LEFT JOIN wf w ON w.ts = f.ts JOIN pf p ON p.event_type = f.event_type AND p.ts = f.ts
        JOIN sf g ON g.event_type = f.event_type AND g.ts = f.ts),
    hs AS (SELECT *, {', '.join(f'lag(value, {k}) OVER w AS l{k}' for k in (1, 24, 48, 168))},
        {O.rolling(24, 'value', O.BY_TYPE)['mean']} AS mean24 FROM ft WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    {O.targets('hs', 'bt', O.BY_TYPE).strip()},
    ok AS (SELECT *, {O.SPLIT} AS split FROM bt_long WHERE target IS NOT NULL AND wind IS NOT NULL AND mean24 IS NOT NULL
        AND l1 IS NOT NULL AND l24 IS NOT NULL AND l48 IS NOT NULL AND l168 IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL)"""

ORACLE = {
    "boost_checks": f"""WITH {_BOOST}
        SELECT horizon, feature_set, count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows,
            count(*) FILTER (split <> 'train') AS predicted_rows, 3::BIGINT AS candidates, 1::BIGINT AS chosen, TRUE AS least_loss_chosen,
            TRUE AS near_or_below_constant
        FROM ok CROSS JOIN (VALUES ('plain'), ('weather')) f(feature_set) GROUP BY 1, 2""",
    "boost_stump": f"""WITH e AS (SELECT value AS y, (event_type = 'view')::INTEGER::DOUBLE AS is_view FROM events WHERE value IS NOT NULL),
        base AS (SELECT {', '.join(f'quantile_disc(y, {a}) AS b{k}' for k, a in enumerate((0.1, 0.5, 0.9)))} FROM e)
        SELECT is_view, count(*) AS row_count, {', '.join(O.r(f'any_value(b{k}) + 0.5 * quantile_disc(y - b{k}, {a})', f'pred_q{int(100 * a)}')
            for k, a in enumerate((0.1, 0.5, 0.9)))} FROM e CROSS JOIN base GROUP BY 1""",
    "arma_checks": f"""WITH {O.SERIES} SELECT event_type, count(*) AS row_count, count(*) AS forecasts, 1::BIGINT AS models,
        min(ts) AS start_utc, max(ts) AS end_utc FROM series WHERE ts > {O.VALIDATION} GROUP BY 1""",
    "arma_path": f"""WITH RECURSIVE {O.SERIES},
        {O.interpolated('series', 'fl', 'event_type', 1000, 'linear').strip()},
        st AS (SELECT event_type, max(ts) AS origin, list(value ORDER BY ts)[-25:] AS z, max_by(value - before, ts) AS e
            FROM (SELECT *, lag(value) OVER {O.TYPE_ORDER} AS before FROM fl) GROUP BY 1),
        fin AS (SELECT max(origin) + INTERVAL 100 HOUR AS ts FROM st),
        go AS (SELECT event_type, origin, 0 AS h, z, e FROM st UNION ALL
            SELECT event_type, origin, h + 1, z[2:] || [{_b0} + {_b1} * z[25] + {_b24} * z[2] + {_b25} * z[1] + CASE WHEN h = 0 THEN {_m1} * e ELSE 0 END], e
            FROM go WHERE origin + to_hours(h) < (SELECT ts FROM fin))
        SELECT event_type, origin + to_hours(h) AS ts, h::INTEGER AS lead_steps, {O.r('z[25]', 'forecast')} FROM go WHERE h > 0""",
    "walk_forward_fitted": f"""WITH {_FOLD_CTES}
        SELECT event_type, count(*) AS folds, sum(unscored_count)::BIGINT AS unscored_count, {O.r('avg(mae)', 'mae_mean')},
            {O.r('stddev_samp(mae)', 'mae_std')}, {O.r('avg(rmse)', 'rmse_mean')}, {O.r('stddev_samp(rmse)', 'rmse_std')} FROM pf GROUP BY 1""",
    "walk_forward_fitted_folds": f"""WITH {_FOLD_CTES}
        SELECT event_type, fold, row_count, {O.r('mae', 'mae')}, {O.r('rmse', 'rmse')}, unscored_count FROM pf""",
}
