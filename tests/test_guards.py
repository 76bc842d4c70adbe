"""Irregular inputs either give the right answer or fail: none loses rows without a word."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.models import seasonal_arma as A
from tidegrid.models import seasonal_naive as N
from tidegrid.operators import ranking as R
from tidegrid.operators.features import add_history_features
from tidegrid.operators.horizons import add_horizon_targets
from tidegrid.plans import reports as RP
from tidegrid.session import in_utc
from tidegrid.sources import documents as D
from tidegrid.sources import tables as TB

T0 = dt.datetime(2024, 1, 1)


def observed(spark, hours, value=float):
    rows = [("a", T0 + dt.timedelta(hours=h), value(h)) for h in hours]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")


def hour(ts):
    return int((ts - T0).total_seconds() // 3600)


@pytest.mark.parametrize("rows", [5, 16, 64, None])
def test_lags_and_targets_of_absent_hours(spark, rows):
    hours = [h for h in range(80) if h % 7 not in (3, 4)]
    df = observed(spark, hours)
    kw = dict(value="y", ts="ts", series_keys=["series"], prefix="y", rows=rows)
    for r in add_history_features(df, lags=(1, 24), rolling=(3,), **kw).collect():
        h = hour(r.ts)
        assert (r.y_lag_1, r.y_lag_24) == tuple(float(h - k) if h - k in hours else None for k in (1, 24))
        assert r.y_rollmean_3 == (h - 1.0 if {h - 1, h - 2} <= set(hours) else None)
    for r in add_horizon_targets(df, horizons={"t2": 2}, **kw).collect():
        h = hour(r.ts) + 2
        assert (r.y_target_t2, r.target_available_t2) == ((float(h), 1) if h in hours else (None, 0))
        assert (r.target_timestamp_t2 is None) == (h not in hours)


def arma_rows(spark, long_level=0.0):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        split = "train" if i < 300 else "validation" if i < 340 else "test"
        rows.append(("long", T0 + dt.timedelta(hours=i), float(rng.normal() + long_level), split))
        if i < 6 or i >= 340:
            rows.append(("short", T0 + dt.timedelta(hours=i), float(rng.normal()), split))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, split string")


SPEC = {"name": "m", "order": (1, 0, 1), "seasonal_order": (0, 0, 0, 24)}


def test_arma_keeps_rows_of_a_series_too_short_to_fit(spark):
    df = arma_rows(spark)
    kw = dict(value="y", ts="ts", series_keys=["series"])
    out = A.refit_and_score_test(df, SPEC, steps=60, **kw).toPandas()
    assert out.groupby("series").size().to_dict() == {"long": 60, "short": 60}
    assert out[out.series == "short"].forecast.isna().all() and out[out.series == "long"].forecast.notna().all()
    best, table = A.search_orders(df.where("series = 'long'"), steps=40, candidates=[SPEC], **kw)
    assert best["name"] == "m" and table.first().unforecast_rows == 0


def test_arma_level_is_the_last_known_value(spark):
    values = [900.0 + i + (i % 5) / 7 for i in range(200)]
    rows = [("a", T0 + dt.timedelta(hours=i), None if i >= 150 else v, "train") for i, v in enumerate(values)]
    rows += [("a", T0 + dt.timedelta(hours=200 + i), 0.0, "test") for i in range(5)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, split string")
    spec = {"name": "d", "order": (1, 1, 1), "seasonal_order": (0, 0, 0, 24)}
    out = A.refit_and_score_test(df, spec, value="y", ts="ts", steps=5, series_keys=["series"]).toPandas()
    assert len(out) == 5 and (out.forecast > 900).all()


def test_series_that_end_apart_are_forecast_to_the_common_end(spark):
    rng = np.random.default_rng(5)
    rows = [(s, T0 + dt.timedelta(hours=i), float(rng.normal())) for s, n in (("a", 200), ("b", 190)) for i in range(n)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")
    kw = dict(value="y", ts="ts", order=(1, 0, 1), seasonal_order=(0, 0, 0, 24), series_keys=["series"])
    fits, residuals = A.fit_seasonal_arma(df, **kw)
    out = A.forecast_seasonal_arma(fits, residuals, steps=5, **kw).toPandas()
    assert out.groupby("series").size().to_dict() == {"a": 5, "b": 15} and out.ts.max() == out[out.series == "b"].ts.max()


def test_pivot_of_an_unlisted_model_fails(spark):
    df = spark.createDataFrame([("h", "A", 2.0), ("h", "B", 1.0)], "horizon string, model string, rmse double")
    assert RP.model_comparison(df, ["A", "B"]).first().best_model == "B"
    with pytest.raises(Exception, match="not in the list"):
        RP.model_comparison(df, ["A"]).collect()
    assert df.select(R.listed("model", ["A", "B"])).count() == 2


def test_summary_without_horizons_fails(spark):
    df = spark.createDataFrame([("m", '{"other": 1}')], "model string, payload string")
    with pytest.raises(Exception, match="no horizons"):
        RP.model_horizon_rmse(df.withColumn("payload", F.parse_json("payload"))).collect()


def test_naive_counts_what_it_can_t_score(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), float(i), "train" if i < 10 else "validation") for i in range(30)]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, split string")
    with pytest.raises(Exception, match="seasonal lag exceeds"):
        N.evaluate_seasonal_naive(df, value="y", ts="ts", season=20).collect()
    row = N.evaluate_seasonal_naive(df, value="y", ts="ts", season=20, strict=False).first()
    assert (row.row_count, row.unscored_count) == (10, 10)


def test_nan_of_parquet_is_null(spark, tmp_path):
    frame = spark.createDataFrame([(float("nan"), float("nan")), (1.0, 2.0)], "a double, b float")
    frame.write.parquet(str(tmp_path / "t"))
    assert TB.read_table(spark, str(tmp_path / "t")).agg(F.avg("a"), F.avg("b"), F.count("a")).first() == (1.0, 2.0, 1)


POINT = "<Point><position>1</position><quantity>2.5</quantity></Point>"


def parse(spark, text):
    return D.parse_series_xml(spark.createDataFrame([(text,)], "content string"), dataset_name="x").collect()


def test_xml_at_any_depth(spark):
    period = f"<Period><timeInterval><start>S</start></timeInterval><resolution>PT60M</resolution>{POINT}<Point/></Period>"
    text = (
        '<?xml version="1.0"?><d:Doc xmlns:d="urn:x" xmlns="urn:y"><!-- <Point> --><Box><TimeSeries><businessType>A1</businessType>'
        f'<MktPSRType a="1"><psrType>B16</psrType></MktPSRType><W><V><psrType> B19 </psrType></V></W><C>{period}</C></TimeSeries></Box>'
        f"<TimeSeries><MktPSRType><psrType>B19</psrType></MktPSRType><psrType>B16</psrType>{period}</TimeSeries></d:Doc>"
    )
    got = [(r.series_index, r.business_type, r.psr_type, r.period_start, r.position, r.quantity) for r in parse(spark, text)]
    assert got == [
        (1, "A1", "B19", "S", 1, 2.5), (1, "A1", "B19", "S", None, None),
        (2, None, "B16", "S", 1, 2.5), (2, None, "B16", "S", None, None),
    ]


def test_xml_point_outside_of_a_period_fails(spark):
    with pytest.raises(Exception, match="outside of a series"):
        parse(spark, f"<Doc><TimeSeries>{POINT}</TimeSeries></Doc>")


def test_another_time_zone_is_left_as_it_is(spark):
    zone = "spark.sql.session.timeZone"
    assert in_utc(spark) is spark
    other = spark.newSession()
    other.conf.set(zone, "Asia/Tokyo")
    assert in_utc(other).conf.get(zone) == "UTC" and other.conf.get(zone) == "Asia/Tokyo"
