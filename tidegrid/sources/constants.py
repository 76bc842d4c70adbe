"""Fixed tables of the forecasting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators.horizons import HORIZONS

# Variables of the weather feed and their column names.
WEATHER_VARIABLES = {
    "T2M": "temp_2m_c",
    "RH2M": "rel_humidity_2m_pct",
    "WS10M": "wind_speed_10m_ms",
    "WD10M": "wind_direction_10m_deg",
    "PS": "surface_pressure_kpa",
    "PRECTOTCORR": "precipitation_mm_hr",
    "ALLSKY_SFC_SW_DWN": "allsky_surface_solar_downward_wm2",
}

# Feature columns of the quantile models.
CALENDAR_FEATURES = (
    "hour_of_day",
    "day_of_week",
    "month",
    "day_of_year",
    "sin_hour",
    "cos_hour",
    "sin_dow",
    "cos_dow",
    "sin_month",
    "cos_month",
)
MODEL_FEATURES = (
    *CALENDAR_FEATURES,
    "load_lag_1",
    "load_lag_24",
    "load_lag_48",
    "load_lag_168",
    "load_rollmean_24",
    "load_rollstd_24",
    "wind_onshore_mw",
    "wind_missing_flag_postfill",
)

# Candidate settings of the boosted quantile model.
BOOST_CANDIDATES = (
    {"name": "gbr_small", "n_estimators": 200, "learning_rate": 0.05, "max_depth": 3,
     "min_samples_leaf": 10, "subsample": 1.0},
    {"name": "gbr_medium", "n_estimators": 300, "learning_rate": 0.05, "max_depth": 3,
     "min_samples_leaf": 10, "subsample": 1.0},
    {"name": "gbr_deeper", "n_estimators": 300, "learning_rate": 0.03, "max_depth": 4,
     "min_samples_leaf": 10, "subsample": 1.0},
)

# Candidate orders of the seasonal ARMA baseline.
ARMA_CANDIDATES = (
    {"name": "sarimax_101_101_24", "order": (1, 0, 1), "seasonal_order": (1, 0, 1, 24)},
    {"name": "sarimax_111_101_24", "order": (1, 1, 1), "seasonal_order": (1, 0, 1, 24)},
    {"name": "sarimax_201_101_24", "order": (2, 0, 1), "seasonal_order": (1, 0, 1, 24)},
)

# What the forecasting task asks for.
TASK = {
    "temporal_resolution": "Hourly",
    "interval_levels": (0.8, 0.9),
    "point_metrics": ("RMSE", "MAE"),
    "split_policy": "time-based",
    "backtesting": "rolling-origin",
    "random_seed": 42,
}

# Nominal level of the reported interval.
NOMINAL_COVERAGE = 0.8


def horizon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HORIZONS.items()), "horizon string, lead_hours int")


def boost_candidate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [tuple(c.values()) for c in BOOST_CANDIDATES],
        "name string, n_estimators int, learning_rate double, max_depth int, "
        "min_samples_leaf int, subsample double",
    )


def arma_candidate_table(spark: SparkSession) -> DataFrame:
    rows = [(c["name"], list(c["order"]), list(c["seasonal_order"])) for c in ARMA_CANDIDATES]
    return spark.createDataFrame(
        rows, "name string, `order` array<int>, seasonal_order array<int>"
    )


def weather_variable_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(WEATHER_VARIABLES.items()), "variable string, column_name string"
    )


def feature_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f,) for f in MODEL_FEATURES], "feature string")


def task_table(spark: SparkSession) -> DataFrame:
    """Task settings as text rows."""
    return spark.createDataFrame([(k, str(v)) for k, v in TASK.items()], "setting string, value string")
