"""Published row counts, rebuilt from a synthetic series with the published gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.scalars import add_missing_flags
from tidegrid.operators import audit as AU
from tidegrid.operators import horizons as H
from tidegrid.operators import splits as S
from tidegrid.operators.fill import drop_incomplete
from tidegrid.operators.features import add_history_features
from tidegrid.plans import modeling as ML

# The hours of missing load values in 2024 in their published order, and the one hour without a row.
NULL_HOURS = (
    "2024-02-13 13:00",
    "2024-02-17 22:00",
    "2024-02-17 23:00",
    "2024-02-18 04:00",
    "2024-02-18 08:00",
    "2024-02-18 14:00",
    "2024-02-18 15:00",
    "2024-02-19 02:00",
    "2024-02-22 12:00",
    "2024-02-23 01:00",
    "2024-02-27 15:00",
    "2024-03-01 10:00",
    "2024-03-04 01:00",
    "2024-03-04 06:00",
    "2024-03-05 22:00",
    "2024-03-06 09:00",
    "2024-03-06 15:00",
    "2024-03-06 20:00",
    "2024-03-08 00:00",
    "2024-03-10 00:00",
    "2024-03-10 18:00",
    "2024-03-11 10:00",
    "2024-03-12 14:00",
    "2024-03-12 22:00",
    "2024-03-14 13:00",
    "2024-03-14 14:00",
    "2024-03-15 18:00",
    "2024-03-15 19:00",
    "2024-03-15 21:00",
    "2024-03-16 08:00",
    "2024-03-20 14:00",
    "2024-03-20 15:00",
    "2024-03-20 16:00",
    "2024-03-25 12:00",
    "2024-03-25 18:00",
    "2024-03-26 20:00",
    "2024-03-28 10:00",
    "2024-03-28 18:00",
    "2024-03-29 20:00",
    "2024-04-04 04:00",
    "2024-04-06 18:00",
    "2024-04-06 19:00",
    "2024-04-07 17:00",
    "2024-04-09 16:00",
    "2024-04-10 16:00",
    "2024-04-11 03:00",
    "2024-04-11 10:00",
    "2024-04-11 23:00",
    "2024-04-12 18:00",
    "2024-04-13 21:00",
    "2024-04-14 18:00",
    "2024-04-14 20:00",
    "2024-04-15 10:00",
    "2024-04-15 19:00",
    "2024-04-15 21:00",
    "2024-04-16 18:00",
    "2024-04-16 19:00",
    "2024-04-16 20:00",
    "2024-04-18 16:00",
    "2024-04-18 21:00",
    "2024-04-20 05:00",
    "2024-04-20 12:00",
    "2024-09-20 09:00",
    "2024-10-15 14:00",
    "2024-10-26 23:00",
    "2024-10-27 00:00",
    "2024-11-20 05:00",
)
MISSING_HOUR = dt.datetime(2024, 12, 31, 23)
START, END = "2024-01-01 00:00:00", "2024-12-31 23:00:00"
TRAIN_END, VALIDATION_START = "2024-09-30 23:00:00", "2024-10-01 00:00:00"
VALIDATION_END, TEST_START = "2024-11-15 23:00:00", "2024-11-16 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def null_hours():
    return {dt.datetime.strptime(h, "%Y-%m-%d %H:%M") for h in NULL_HOURS}


@pytest.fixture(scope="module")
def load(spark):
    gaps = null_hours()
    assert len(gaps) == 67
    rows = []
    for i in range(8784):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        if t != MISSING_HOUR:
            rows.append((t, None if t in gaps else 4000.0 + i % 24))
    return spark.createDataFrame(rows, "ts timestamp_ntz, load_mw double").cache()


@pytest.fixture(scope="module")
def modeling(spark, load):
    wind = spark.createDataFrame([("B19", dt.datetime(2024, 1, 1), 5.0)], "psr_type string, ts timestamp_ntz, generation_mw double")
    table = ML.build_modeling_table(
        ML.prepare_load(load, ts="ts", start=at(START), end=at(END)),
        ML.prepare_wind(wind, ts="ts", start=at(START), end=at(END)),
        ts="ts",
    )
    return table.cache()


def test_audit_counts(load):
    row = AU.series_audit(load, ts="ts", value="load_mw", start=at(START), end=at(END)).first()
    assert (row.expected_count, row.observed_count, row.missing_count, row.null_count, row.duplicate_count) == (
        8784, 8783, 1, 67, 0,
    )


def test_modeling_table(modeling):
    assert modeling.columns == [
        "ts", "load_mw", "load_missing_flag", "wind_onshore_mw", "wind_missing_flag_raw",
        "wind_missing_flag_postfill", "hour_of_day", "day_of_week", "month", "day_of_year", "sin_hour",
        "cos_hour", "sin_dow", "cos_dow", "sin_month", "cos_month", "load_lag_1", "load_lag_24",
        "load_lag_48", "load_lag_168", "load_rollmean_24", "load_rollstd_24",
        "target_available_for_training",
    ]
    row = modeling.agg(
        F.count("*").alias("n"), F.sum("load_missing_flag").alias("missing"),
        F.sum("target_available_for_training").alias("trainable"),
        F.count("wind_onshore_mw").alias("wind"),
    ).first()
    assert (row.n, row.missing, row.trainable, row.wind) == (8784, 68, 8716, 4)


@pytest.mark.parametrize("closed", [True, False])
def test_base_split(modeling, closed):
    label = (
        S.closed_split(F.col("ts"), *map(at, (TRAIN_END, VALIDATION_START, VALIDATION_END, TEST_START)))
        if closed
        else S.half_open_split(F.col("ts"), at(TRAIN_END), at(VALIDATION_END))
    )
    usable = H.available_rows(modeling, "target_available_for_training")
    counts = {r.split: r.row_count for r in S.split_summary(S.add_split(usable, label), ts="ts").collect()}
    assert counts == {"train": 6513, "validation": 1101, "test": 1102}


HISTORY = ["load_lag_1", "load_lag_24", "load_lag_48", "load_lag_168", "load_rollmean_24", "load_rollstd_24"]
HORIZON_COUNTS = {
    "t_plus_1": ((8715, 69), (6513, 1101, 1101), (5399, 1045, 1074)),
    "t_plus_24": ((8692, 92), (6513, 1101, 1078), (5397, 1044, 1051)),
    "t_plus_168": ((8548, 236), (6513, 1100, 935), (5392, 1043, 908)),
}


def test_horizon_tables(modeling):
    wide = ML.build_horizon_table(modeling, ts="ts")
    long = H.long_horizons(wide).cache()
    available = {r.horizon: (r.available_count, r.missing_count) for r in H.horizon_summary(long, "ts").collect()}
    split = S.add_split(
        H.available_rows(long, "target_available"), S.half_open_split(F.col("ts"), at(TRAIN_END), at(VALIDATION_END))
    )

    def counts(df):
        rows = S.split_summary(df, ts="ts", by=("horizon",)).collect()
        found = {(r.horizon, r.split): r.row_count for r in rows}
        return {h: tuple(found[h, s] for s in S.SPLITS) for h in HORIZON_COUNTS}

    # The target hour's own value is a feature only of the same-hour baseline.
    complete = counts(drop_incomplete(split, [*HISTORY, "load_mw"]))
    splits = counts(split)
    assert {h: (available[h], splits[h], complete[h]) for h in HORIZON_COUNTS} == HORIZON_COUNTS


def test_lag_equals_time_join(modeling):
    past = modeling.select((F.col("ts") + F.expr("INTERVAL 48 HOURS")).alias("ts"), F.col("load_mw").alias("past"))
    joined = modeling.join(past, "ts", "left")
    assert joined.where(~F.col("load_lag_48").eqNullSafe(F.col("past"))).count() == 0


@pytest.mark.parametrize("rows", [200, 1000])
def test_chunk_size_does_not_change_history(modeling, rows):
    base = modeling.select("ts", "load_mw")
    small = add_history_features(base, ts="ts", rows=rows).exceptAll(modeling.select("ts", "load_mw", *HISTORY))
    assert small.where("load_rollstd_24 is null").count() == 0
    exact = add_history_features(base, ts="ts", rows=rows).drop("load_rollstd_24", "load_rollmean_24")
    assert exact.exceptAll(modeling.select(*exact.columns)).count() == 0


def test_weather_table_has_44_columns(modeling, spark):
    from tidegrid.sources.constants import WEATHER_VARIABLES

    names = list(WEATHER_VARIABLES.values())
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), *[float(i)] * 7) for i in range(1000)]
    weather = spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names))
    out = ML.add_weather(modeling, weather, names, ts="ts")
    assert len(out.columns) == 44
    quality = AU.column_quality(out, names).collect()
    assert {(r.raw_missing_count, r.postfill_missing_count) for r in quality} == {(7784, 8784 - 4996 - 6)}
    assert add_missing_flags(out, names, "_x").columns[-1] == f"{names[-1]}_x"
