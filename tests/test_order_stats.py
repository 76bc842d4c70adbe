import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators.chunks import keyed_lookup
from tidegrid.operators.conformal import conformal_adjustment, conformal_calibrate
from tidegrid.operators.metrics import metric_table
from tidegrid.operators.order_stats import approximate_median, median, medians, order_statistic, order_statistics


def make(spark, seed=1, groups=3, size=4000):
    rng = np.random.default_rng(seed)
    pdf = pd.concat(
        pd.DataFrame({"g": f"g{i}", "id": range(size + i), "v": np.round(rng.normal(size=size + i), 2)})
        for i in range(groups)
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("left", [1, 100, 10_000])
def test_median_is_exact_however_often_it_narrows(spark, left):
    pdf, df = make(spark)
    out = median(df, "v", keys=["g"], left=left).toPandas().set_index("g")["median"]
    want = pdf.groupby("g")["v"].median()
    np.testing.assert_allclose(out.sort_index(), want.sort_index(), atol=1e-12)
    overall = median(df, "v", left=left).first()["median"]
    assert overall == pytest.approx(pdf["v"].median(), abs=1e-12)


def test_median_of_one_hot_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [5] * 3000 + list(range(50))], "v double")
    assert median(df, "v", left=50).first()["median"] == 5.0


def test_rank_beyond_group_is_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    row = order_statistic(df, "v", {"k": lambda n: n + 1}).first()
    assert (row["n"], row["k"]) == (2, None)


def test_approximate_median_close(spark):
    pdf, df = make(spark)
    got = approximate_median(df, "v", keys=["g"]).toPandas().set_index("g")["median"]
    assert (got - pdf.groupby("g")["v"].median()).abs().max() < 0.02


@pytest.mark.parametrize("n", [1, 3, 4, 9, 1045])
@pytest.mark.parametrize("left", [1, 10_000])
def test_conformal_rank(spark, n, left):
    rng = np.random.default_rng(n)
    scores = rng.permutation(n).astype(float)
    df = spark.createDataFrame([("m", float(s), 0.0, 0.0) for s in scores], "m string, y double, lo double, hi double")
    got = conformal_adjustment(df, actual="y", lower="lo", upper="hi", keys=["m"], left=left).first()
    k = math.ceil((n + 1) * 0.8 - 1e-9)
    assert got["n"] == n
    assert got["adjustment"] == (None if k > n else sorted(scores)[k - 1])


def test_calibration_widens_by_twice_the_adjustment(spark):
    rng = np.random.default_rng(8)
    rows = [
        (s, i, float(rng.normal()), -0.5, 0.0, 0.5)
        for s in ("validation", "test")
        for i in range(1045)
    ]
    df = spark.createDataFrame(rows, "split string, id int, y double, pred_q10 double, pred_q50 double, pred_q90 double")
    out = conformal_calibrate(df, actual="y").cache()
    raw = metric_table(out, actual="y", by=["split"]).toPandas().set_index("split")
    calibrated = metric_table(
        out, actual="y", by=["split"], intervals={80: ("calibrated_lower", "calibrated_upper")}
    ).toPandas().set_index("split")
    c = out.first()["adjustment"]
    np.testing.assert_allclose(calibrated["width_80"] - raw["width_80"], 2 * c)
    assert round(calibrated.loc["validation", "coverage_80"] * 1045) == 837
    np.testing.assert_allclose(raw["mae"], 2 * raw["pinball_q50"])


def test_unbounded_interval_covers_everything(spark):
    df = spark.createDataFrame([("validation", 5.0, 1.0, 2.0), ("test", 9.0, 1.0, 2.0)], "split string, y double, pred_q10 double, pred_q90 double")
    out = conformal_calibrate(df, actual="y").collect()
    assert all(r.adjustment is None and r.calibrated_upper == float("inf") for r in out)


def test_keyed_lookup_keeps_every_row_once(spark):
    big = spark.range(1000).selectExpr("id", "if(id < 900, 'hot', 'cold') k")
    small = spark.createDataFrame([("hot", 1), ("other", 2)], "k string, v int")
    out = keyed_lookup(big, small, ["k"])
    assert out.count() == 1000
    assert out.where("v = 1").count() == 900


@pytest.mark.parametrize("left, bins", [(2, 2), (5, 4096)])
def test_ranks_of_extreme_values(spark, left, bins):
    """Infinite ends, both signs of zero, tiny and huge values, ties and NULLs, with and without keys."""
    inf = float("inf")
    values = [-inf, -1e308, -2.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0, 1.0, 3.0, 1e308, inf, None]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 7.0), ("none", None)], "g string, v double")
    ranks = {f"r{k}": ("v", lambda n, k=k: n * 0 + k) for k in range(15)}
    rows = {r.g: r for r in order_statistics(df, ranks, keys=["g"], left=left, bins=bins).collect()}
    assert [rows["a"][f"r{k}"] for k in range(15)] == [None, *sorted(v for v in values if v is not None), None]
    assert rows[None].r1 == 7.0 and rows[None].n == {"v": 1} and rows["a"].n == {"v": 13} and "none" not in rows
    alone = order_statistics(df.limit(0), ranks, left=left).collect()
    assert len(alone) == 1 and alone[0].r1 is None


def test_several_columns_in_one_pass(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "a": rng.exponential(size=500) ** 9, "b": rng.normal(size=500)})
    pdf.loc[::7, "b"] = None
    df = spark.createDataFrame(pdf).withColumn("b", F.nanvl("b", F.lit(None).cast("double")))
    got = medians(df, ["a", "b"], keys=["g"], left=3).toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(got, pdf.groupby("g")[["a", "b"]].median())
