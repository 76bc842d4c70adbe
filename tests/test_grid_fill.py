import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import chunks as C
from tidegrid.operators import grid as G
from tidegrid.operators.features import add_history_features, resample_with_history
from tidegrid.operators.fill import impute_train_median, interpolate

T0 = dt.datetime(2024, 1, 1)


def at(hours=0, minutes=0):
    return T0 + dt.timedelta(hours=hours, minutes=minutes)


def frame(spark, rows, series=False):
    schema = "series string, ts timestamp_ntz, y double" if series else "ts timestamp_ntz, y double"
    return spark.createDataFrame(rows, schema)


def test_collapse_skips_null_and_drops_null_keys(spark):
    rows = [("a", at(), 10.0), ("a", at(), 20.0), ("a", at(), None), ("b", at(), None), (None, at(), 1.0)]
    out = G.collapse_duplicates(frame(spark, rows, True), ts="ts", value="y", series_keys=["series"])
    assert {(r.series, r.y) for r in out.collect()} == {("a", 15.0), ("b", None)}


def test_resample_is_mean_of_means_and_emits_empty_hours(spark):
    rows = [(at(0), 10.0), (at(0), 20.0), (at(0, 30), 30.0), (at(2), 7.0)]
    out = G.resample_mean(frame(spark, rows), ts="ts", value="y").orderBy("ts").collect()
    assert [(r.ts, r.y) for r in out] == [(at(0), 22.5), (at(1), None), (at(2), 7.0)]


def test_unique_times_skip_the_duplicate_average(spark):
    rows = [(at(0), 10.0), (at(0, 20), 20.0), (at(2), 7.0)]
    out = G.resample_mean(frame(spark, rows), ts="ts", value="y", unique_times=True).orderBy("ts")
    assert [r.y for r in out.collect()] == [15.0, None, 7.0]


@pytest.mark.parametrize("end", [None, 4])
def test_materialized_resample_is_the_same(spark, end):
    rows = [("a", at(h, m), float(h + m)) for h in (0, 2, 5) for m in (0, 0, 30)] + [("b", at(9), 1.0)]
    df = frame(spark, rows, True)
    options = dict(ts="ts", value="y", series_keys=["series"])
    if end:
        options |= {"start": F.lit(at(1)), "end": F.lit(at(end))}
    lazy, stored = (G.resample_mean(df, materialize=m, **options) for m in (False, True))
    assert sorted(lazy.collect()) == sorted(stored.collect()) and lazy.count() == (8 if end else 7)


def test_grouped_resample_uses_own_range(spark):
    rows = [("a", at(h), 1.0) for h in (0, 5)] + [("b", at(h), 1.0) for h in (2, 3)]
    out = G.resample_mean(frame(spark, rows, True), ts="ts", value="y", series_keys=["series"])
    assert {r.series: r["count"] for r in out.groupBy("series").count().collect()} == {"a": 6, "b": 2}


def test_resample_over_fixed_range(spark):
    rows = [(at(1), 4.0), (at(9), 9.0)]
    out = G.resample_mean(
        frame(spark, rows), ts="ts", value="y", start=F.lit(at(0)), end=F.lit(at(3))
    ).orderBy("ts")
    assert [r.y for r in out.collect()] == [None, 4.0, None, None]


def test_grid_spans_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", 7)
    rows = [("a", at(h), 1.0) for h in (3, 50)] + [("b", at(h), 1.0) for h in (20, 21)]
    out = G.build_grid(frame(spark, rows, True), ts="ts", series_keys=["series"]).collect()
    assert sorted(r.ts for r in out if r.series == "a") == [at(h) for h in range(3, 51)]
    assert sorted(r.ts for r in out if r.series == "b") == [at(20), at(21)]


def test_grid_before_the_epoch(spark):
    early = dt.datetime(1969, 12, 31, 22, 30)
    rows = [(early, 1.0), (dt.datetime(1970, 1, 1, 1), 2.0)]
    out = G.resample_mean(frame(spark, rows), ts="ts", value="y").orderBy("ts").collect()
    assert [r.ts.hour for r in out] == [22, 23, 0, 1]


def test_align_and_missing_agree(spark):
    rows = [(at(h), float(h)) for h in (0, 1, 4)]
    df = frame(spark, rows)
    aligned = G.align_to_grid(df, ts="ts")
    gaps = {r.ts for r in aligned.where("y is null").collect()}
    missing = {r.ts for r in G.missing_timestamps(df, ts="ts").collect()}
    assert gaps == missing == {at(2), at(3)}
    grid = G.build_grid(df, ts="ts")
    assert {r.ts for r in G.timestamp_difference(grid, df, ["ts"]).collect()} == missing


def test_off_grid_rows_do_not_count_as_observed(spark):
    out = G.missing_timestamps(frame(spark, [(at(0), 1.0), (at(1, 30), 1.0), (at(2), 1.0)]), ts="ts")
    assert [r.ts for r in out.collect()] == [at(1)]


def test_row_number_matches_plain_order(spark):
    rng = np.random.default_rng(3)
    rows = [
        (s, at(int(h)), 1.0)
        for s in ("a", "b")
        for h in rng.choice(500, size=120, replace=False)
    ]
    out = C.add_row_number(
        frame(spark, rows, True), ts="ts", series_keys=["series"], rows=16
    ).toPandas()
    for _, part in out.groupby("series"):
        part = part.sort_values("ts")
        assert part["row_number"].tolist() == list(range(1, 121))


LONG_GAP_IN = [None] * 5 + [10.0] + [None] * 8 + [26.0, None, None, 30.0] + [None] * 5
LONG_GAP_OUT = [
    None, None, 10, 10, 10, 10, 11.778, 13.556, 15.333, None, None, 20.667, 22.444, 24.222,
    26, 27.333, 28.667, 30, 30, 30, 30, None, None,
]


@pytest.mark.parametrize("method", ["linear", "time"])
@pytest.mark.parametrize("rows", [None, 4])
def test_interpolation_fixture(hourly, method, rows):
    out = interpolate(hourly(LONG_GAP_IN), "y", ts="ts", limit=3, method=method, rows=rows)
    got = [None if r.y is None else round(r.y, 3) for r in out.orderBy("ts").collect()]
    assert got == LONG_GAP_OUT


@pytest.mark.parametrize("rows", [8, None])
def test_interpolation_matches_pandas(spark, rows):
    rng = np.random.default_rng(11)
    frames = []
    for s in range(12):
        y = rng.normal(size=60)
        y[rng.random(60) < rng.uniform(0.1, 0.97)] = np.nan
        z = rng.normal(size=60)
        z[rng.random(60) < 0.6] = np.nan
        frames.append(pd.DataFrame({"series": f"s{s}", "ts": pd.date_range(T0, periods=60, freq="h"), "y": y, "z": z}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).replace(float("nan"), None)
    for method, limit in (("linear", 3), ("time", 6)):
        for direction in ("both", "forward"):
            got = interpolate(
                df, ["y", "z"], ts="ts", limit=limit, series_keys=["series"], method=method,
                direction=direction, rows=rows,
            ).toPandas().sort_values(["series", "ts"]).reset_index(drop=True)
            want = pdf.set_index("ts").groupby("series")[["y", "z"]].transform(
                lambda s: s.interpolate(method=method, limit=limit, limit_direction=direction)
            ).reset_index()
            want["series"] = pdf["series"].to_numpy()
            want = want.sort_values(["series", "ts"]).reset_index(drop=True)
            for c in ("y", "z"):
                np.testing.assert_allclose(got[c].astype(float), want[c], atol=1e-9)


def test_irregular_interpolation_counts_rows(spark):
    rng = np.random.default_rng(5)
    hours = np.sort(rng.choice(400, size=80, replace=False))
    y = np.where(rng.random(80) < 0.6, np.nan, rng.normal(size=80))
    index = pd.DatetimeIndex([at(int(h)) for h in hours])
    want = pd.Series(y, index=index).interpolate(method="time", limit=2, limit_direction="both")
    rows = [(t.to_pydatetime(), None if np.isnan(v) else float(v)) for t, v in zip(index, y)]
    got = interpolate(
        frame(spark, rows), "y", ts="ts", limit=2, method="time", regular=False, rows=16
    ).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["y"].astype(float), want.to_numpy(), atol=1e-9)


def test_impute_uses_train_only(spark):
    rows = [("train", 1.0), ("train", 3.0), ("train", None), ("test", None), ("test", 100.0)]
    df = spark.createDataFrame(rows, "split string, x double")
    out = impute_train_median(df, ["x"]).collect()
    assert sorted((r.split, r.x) for r in out) == [
        ("test", 2.0), ("test", 100.0), ("train", 1.0), ("train", 2.0), ("train", 3.0)
    ]
    rough = impute_train_median(df, ["x"], exact=False)
    assert rough.where("x is null").count() == 0


def test_impute_per_series(spark):
    rows = [("a", "train", 1.0), ("a", "test", None), ("b", "train", 9.0), ("b", "test", None)]
    df = spark.createDataFrame(rows, "s string, split string, x double")
    out = impute_train_median(df, ["x"], keys=["s"]).where("split = 'test'")
    assert sorted((r.s, r.x) for r in out.collect()) == [("a", 1.0), ("b", 9.0)]


def test_resample_of_any_gaps_equals_a_loop(spark, monkeypatch):
    """Chunk starts, ends and whole chunks without rows; a NULL value is a row all the same."""
    monkeypatch.setattr(C, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(s, at(int(h)), None if h % 5 == 0 else float(h)) for s in "abc" for h in rng.choice(90, 9, replace=False)]
    out = G.resample_mean(frame(spark, rows, True), ts="ts", value="y", series_keys=["series"]).collect()
    want = {}
    for s in "abc":
        seen = {t: y for k, t, y in rows if k == s}
        hours = int((max(seen) - min(seen)).total_seconds()) // 3600
        want |= {(s, t): seen.get(t) for t in (min(seen) + dt.timedelta(hours=h) for h in range(hours + 1))}
    assert len(out) == len(want) and {(r.series, r.ts): r.y for r in out} == want


def test_no_aggregate_holds_the_empty_slots(spark):
    df = frame(spark, [("a", at(h), 1.0) for h in (0, 5)], True)
    out = G.resample_mean(df, ts="ts", value="y", series_keys=["series"])
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text[: text.index("posexplode")]


@pytest.mark.parametrize("fill", [True, False])
def test_grid_rows_are_dealt_to_a_fixed_number_of_partitions(spark, fill):
    df = G.resample_mean(frame(spark, [("a", at(h), 1.0) for h in (0, 5)], True), ts="ts", value="y", series_keys=["series"])
    if fill:
        out = interpolate(df, "y", ts="ts", limit=3, series_keys=["series"])
    else:
        out = G.timestamp_difference(df, df.where("y IS NOT NULL"), ["series", "ts"])
    text = out._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("posexplode")]
    assert "REPARTITION_BY_NUM" in above


@pytest.mark.parametrize("chunk_rows", [5, 8192])
def test_resample_with_history_equals_the_two_steps(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk_rows)
    rng = np.random.default_rng(5)
    rows = [
        (key, T0 + dt.timedelta(hours=float(h) / 2), None if rng.random() < 0.1 else float(rng.integers(0, 50)))
        for key, share in (("dense", 0.9), ("sparse", 0.1))
        for h in np.flatnonzero(rng.random(160) < share)
    ]
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double")
    options = {"value": "y", "ts": "ts", "series_keys": ["series"]}
    history = {"prefix": "y", "lags": (1, 3, 7), "rolling": (2, 4)}
    want = add_history_features(G.resample_mean(df, **options), **options, **history)
    got = resample_with_history(df, **options, **history)
    assert got.columns == want.columns
    frames = [x.toPandas().sort_values(["series", "ts"]).reset_index(drop=True) for x in (got, want)]
    pd.testing.assert_frame_equal(*frames)
    assert frames[0].notna().sum().min() > 10
