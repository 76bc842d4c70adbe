import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.models import quantile_boost as Q
from tidegrid.models import seasonal_arma as A
from tidegrid.models import seasonal_naive as N
from tidegrid.models.least_squares import fit_least_squares
from tidegrid.operators.splits import RollingOrigin
from tidegrid.plans.walk_forward import fold_metrics, summarise_folds, walk_forward

T0 = dt.datetime(2024, 1, 1)
SMALL = {"name": "small", "n_estimators": 12, "learning_rate": 0.3, "max_depth": 3, "min_samples_leaf": 5, "subsample": 1.0}


def series_frame(spark, values, split_at=None, series="a"):
    rows = []
    for i, v in enumerate(values):
        split = None
        if split_at:
            split = "train" if i < split_at[0] else "validation" if i < split_at[1] else "test"
        rows.append((series, T0 + dt.timedelta(hours=i), None if v is None else float(v), split))
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, y double, split string")


@pytest.mark.parametrize("rows", [None, 40])
def test_naive_rows_and_time_modes(spark, rows):
    df = series_frame(spark, range(100)).where("y not in (50, 51)")
    kw = dict(value="y", ts="ts", series_keys=["series"], season=24, rows=rows)
    by_rows = {r.y: r.forecast for r in N.seasonal_naive(df, mode="rows", **kw).collect()}
    by_time = {r.y: r.forecast for r in N.seasonal_naive(df, mode="time", **kw).collect()}
    assert by_rows[49] == 25 and by_rows[52] == 26 and by_rows[99] == 75
    assert by_time[52] == 28 and by_time[74] is None and by_time[99] == 75
    assert by_rows[10] is None


def test_naive_strict_raises(spark):
    df = series_frame(spark, range(30), (10, 20))
    with pytest.raises(Exception, match="seasonal lag exceeds"):
        N.evaluate_seasonal_naive(df, value="y", ts="ts", season=24, strict=True).collect()


def test_naive_evaluation(spark):
    df = series_frame(spark, range(100), (60, 80))
    got = {r.split: r.rmse for r in N.evaluate_seasonal_naive(df, value="y", ts="ts", season=24).collect()}
    assert got == {"validation": 24.0, "test": 24.0}


def brute_folds(values, folds, season):
    out = []
    o1 = int((dt.datetime.fromisoformat(folds.first_origin) - T0).total_seconds() // 3600)
    for k in range(1, folds.folds + 1):
        o = o1 + (k - 1) * folds.stride
        for lead in range(1, folds.horizon + 1):
            t = o + lead
            if t < len(values):
                back = -(-lead // season) * season
                out.append((k, t, lead, values[t - back] if t - back >= 0 else None))
    return sorted(out)


@pytest.mark.parametrize("stride,horizon,rows", [(24, 24, None), (10, 30, 50), (40, 25, 64)])
def test_walk_forward_matches_brute_force(spark, stride, horizon, rows):
    values = list(np.random.default_rng(1).normal(size=200).round(3))
    folds = RollingOrigin("2024-01-03 05:00:00", stride, horizon, 4)
    out = N.walk_forward_naive(series_frame(spark, values), folds, value="y", ts="ts", season=12, rows=rows)
    got = sorted(
        (r.fold, int((r.ts - T0).total_seconds() // 3600), r.lead_steps, r.forecast) for r in out.collect()
    )
    assert got == brute_folds(values, folds, 12)


def test_walk_forward_with_a_model(spark):
    folds = RollingOrigin("2024-01-03 00:00:00", 24, 24, 3)
    df = series_frame(spark, range(150))

    def last_mean(train, scored):
        return scored.withColumn("forecast", train.agg(F.max("y")).scalar())

    per_fold = fold_metrics(walk_forward(df, folds, last_mean, ts="ts"), actual="y")
    assert {r.fold: r.mae for r in per_fold.collect()} == {1: 12.5, 2: 12.5, 3: 12.5}
    total = summarise_folds(per_fold).first()
    assert (total.folds, total.mae_mean, total.mae_std) == (3, 12.5, 0.0)


def test_least_squares_matches_numpy(spark):
    rng = np.random.default_rng(2)
    frames = []
    for s in range(4):
        x = rng.normal(size=(200, 2))
        frames.append(pd.DataFrame({"s": s, "a": x[:, 0], "b": x[:, 1], "y": 3 + s * x[:, 0] - 2 * x[:, 1] + rng.normal(size=200)}))
    pdf = pd.concat(frames)
    out = fit_least_squares(spark.createDataFrame(pdf), y="y", x=["a", "b"], keys=["s"]).toPandas()
    for _, row in out.iterrows():
        part = pdf[pdf.s == row.s]
        design = np.column_stack([np.ones(200), part.a, part.b])
        want, rss, *_ = np.linalg.lstsq(design, part.y, rcond=None)
        np.testing.assert_allclose(row.coefficients, want, atol=1e-9)
        assert row.rss == pytest.approx(rss[0], rel=1e-8)


def test_arma_follows_a_seasonal_signal(spark):
    rng = np.random.default_rng(4)
    t = np.arange(700)
    y = 100 + 20 * np.sin(2 * np.pi * t / 24) + rng.normal(scale=1.0, size=700)
    values = [None if i in (200, 201, 333) else v for i, v in enumerate(y)]
    df = series_frame(spark, values, (550, 620))
    best, table = A.search_orders(df, value="y", ts="ts", steps=70, series_keys=["series"])
    results = {r.model_name: r for r in table.collect()}
    assert len(results) == 3 and all(r.error is None for r in results.values())
    assert best["name"] == min(results.values(), key=lambda r: r.rmse).model_name
    forecasts = A.refit_and_score_test(df, best, value="y", ts="ts", steps=80, series_keys=["series"]).toPandas()
    assert len(forecasts) == 80
    rmse = np.sqrt(np.mean((forecasts.y - forecasts.forecast) ** 2))
    assert rmse < 6


def test_arma_records_failures(spark):
    df = series_frame(spark, range(100), (60, 80))
    bad = {"name": "bad", "order": (1, 2, 1), "seasonal_order": (1, 0, 1, 24)}
    with pytest.raises(RuntimeError, match="bad"):
        A.search_orders(df, value="y", ts="ts", steps=20, candidates=[bad])


def boost_frame(spark, n=900):
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, size=(n, 2))
    y = 5 * x[:, 0] + 2 * (x[:, 1] > 0) + rng.normal(scale=0.5 + 0.5 * np.abs(x[:, 0]))
    split = np.where(np.arange(n) < n * 0.6, "train", np.where(np.arange(n) < n * 0.8, "validation", "test"))
    pdf = pd.DataFrame({"id": range(n), "a": x[:, 0], "b": x[:, 1], "y": y, "split": split})
    return spark.createDataFrame(pdf)


def test_boost_beats_constant_and_orders_quantiles(spark):
    df = boost_frame(spark)
    best, table = Q.search_candidates(
        df, target="y", features=["a", "b"], candidates=[dict(SMALL, n_estimators=1, name="one"), SMALL]
    )
    losses = {r.model_name: r.pinball_q50 for r in table.collect()}
    assert best["name"] == "small" and losses["small"] < 0.6 * losses["one"]
    out = Q.refit_and_score_test(df, target="y", features=["a", "b"], config=best, keep=["id"]).toPandas()
    assert len(out) == 180
    assert (out.pred_q10 < out.pred_q90).mean() > 0.95
    covered = ((out.y >= out.pred_q10) & (out.y <= out.pred_q90)).mean()
    assert 0.6 < covered < 0.95


def test_tree_walk_equals_batch_prediction(spark):
    df = boost_frame(spark, 300)
    config = dict(SMALL, n_estimators=2)
    model = Q.fit_quantile_boost(df, target="y", features=["a", "b"], alpha=0.9, config=config)
    column = F.lit(model.base)
    for tree in model.trees:
        column = column + model.learning_rate * tree.walk(["a", "b"], tree.value)
    out = Q.predict_quantiles(df, {"p": model}).withColumn("w", column).toPandas()
    np.testing.assert_allclose(out.p, out.w)


def test_train_horizons_runs_each_target(spark):
    df = boost_frame(spark, 400).withColumn("load_target_t_plus_1", F.col("y")).withColumn("load_target_t_plus_24", -F.col("y"))
    df = df.withColumn("a", F.when(F.col("id") % 17 != 0, F.col("a")))
    out = Q.train_horizons(
        df, labels=["t_plus_1", "t_plus_24"], features=["a", "b"], keep=["id"], impute=["a"],
        candidates=[dict(SMALL, n_estimators=2)],
    )
    assert {r.horizon: r["count"] for r in out.groupBy("horizon").count().collect()} == {"t_plus_1": 80, "t_plus_24": 80}


def test_boosted_horizons_reach_calibration_and_report(spark):
    """Validation rows come from the train-only fit, test rows from the refit; both feed the report."""
    from tidegrid.operators.conformal import conformal_calibrate
    from tidegrid.plans.reports import horizon_report

    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        split = "train" if i < 360 else "validation" if i < 480 else "test"
        a = float(rng.uniform())
        rows.append((i, a, 3 * a + float(rng.normal()) / 5, 2 * a + float(rng.normal()) / 5, split))
    df = spark.createDataFrame(rows, "i int, a double, load_target_near double, load_target_far double, split string")
    config = {"name": "c", "n_estimators": 2, "learning_rate": 0.5, "max_depth": 2, "min_samples_leaf": 5, "subsample": 1.0}
    predictions, table = Q.score_horizons(
        df, horizons={"near": 1, "far": 24}, features=["a"], keep=["i"], candidates=[config]
    )
    counts = {(r.horizon, r.lead_steps, r.split): r["count"] for r in predictions.groupBy("horizon", "lead_steps", "split").count().collect()}
    assert counts == {(h, n, s): 120 for h, n in (("near", 1), ("far", 24)) for s in ("validation", "test")}
    assert {(r.horizon, r.selected) for r in table.collect()} == {("near", True), ("far", True)}
    near = df.withColumnRenamed("load_target_near", "y")
    alone = Q.fit_quantile_boost(near.where("split = 'train'"), target="y", features=["a"], alpha=0.5, config=config)
    want = {r.i: r.q for r in Q.predict_quantiles(near.where("split = 'validation'"), {"q": alone}).collect()}
    got = {r.i: r.pred_q50 for r in predictions.where("horizon = 'near' AND split = 'validation'").collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))
    report = horizon_report(conformal_calibrate(predictions, actual="actual_target_mw", keys=["horizon"]), actual="actual_target_mw")
    assert sorted((r.horizon, r.lead_steps) for r in report.collect()) == [("far", 24), ("near", 1)]


def test_arma_query_reaches_the_last_row(spark, monkeypatch):
    """Validation and test rows later than in the sample tables are forecast and scored."""
    from catalog import fitted, spark_queries as C

    rng, start = np.random.default_rng(6), dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=i), float(50 + 9 * np.sin(i / 3.8) + rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, value double")
    monkeypatch.setattr(C, "by_type", lambda *_: df)
    out = fitted.seasonal_arma(spark, "").toPandas()
    assert len(out) == 900 - 480 and out.forecast.notna().all()




def test_boost_over_partitions_equals_one_partition(spark, monkeypatch):
    """The same passes in one task, summed by the driver, and summed in a shuffle give the same trees."""
    from tidegrid.models import histogram_trees as HT

    df = boost_frame(spark, 700).withColumn("code", F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2))
    df = df.withColumn("z", F.when(F.col("id") % 9 > 0, F.round("y"))).withColumn("a", F.when(F.col("id") % 31 > 0, F.col("a")))
    fits = [
        HT.Fit(target, last, features, alpha, rounds, 0.3, depth, 5)
        for target, last, features, alpha, rounds, depth in (
            (0, 0, (0, 1), 0.1, 4, 2), (0, 1, (0, 1), 0.5, 3, 3), (1, 1, (1,), 0.9, 5, 2), (1, 0, (0,), 0.5, 4, 1)
        )
    ]
    found = []
    for rows, direct in ((1 << 17, 32), (50, 32), (50, 0)):
        monkeypatch.setattr(HT, "TASK_ROWS", rows)
        monkeypatch.setattr(HT, "BLOCK_ROWS", 64)
        monkeypatch.setattr(HT, "ROUNDS_PER_CHECKPOINT", 2)
        monkeypatch.setattr(HT, "DIRECT_PARTITIONS", direct)
        binned = HT.bin_rows(df, features=["a", "b"], targets=["y", "z"], split="code")
        assert (binned.blocks.getNumPartitions() == 1) == (rows > 50)
        found.append(HT.grow(binned, fits))
    for base, trees in found:
        assert base == found[0][0] and [len(t) for t in trees] == [f.rounds for f in fits]
        for mine, first in zip(trees, found[0][1]):
            for tree, other in zip(mine, first):
                assert all((getattr(tree, n) == getattr(other, n)).all() for n in ("feature", "cut", "value"))


def test_one_round_is_the_best_split_and_its_quantiles(spark):
    """Brute force over every cut: the gradient's variance gain, then the lower quantile of the residuals."""
    from tidegrid.models import histogram_trees as HT

    rng = np.random.default_rng(12)
    x, y = rng.integers(0, 20, 200).astype(float), rng.normal(size=200).round(1)
    y += 2 * (x > 13)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for alpha in (0.1, 0.5, 0.9):
        low = lambda v: np.sort(v)[max(1, int(np.ceil(alpha * len(v) - 1e-9))) - 1]  # noqa: E731, B023
        base = low(y)
        g = np.where(y > base, alpha, alpha - 1)
        gains = {c: g[x <= c].sum() ** 2 / (x <= c).sum() + g[x > c].sum() ** 2 / (x > c).sum() for c in range(19) if min((x <= c).sum(), (x > c).sum()) >= 7}
        config = {"n_estimators": 1, "learning_rate": 0.5, "max_depth": 1, "min_samples_leaf": 7, "subsample": 1.0}
        model = Q.fit_quantile_boost(df, target="y", features=["x"], alpha=alpha, config=config)
        cut = model.trees[0].threshold[0]
        assert gains[int(cut)] == pytest.approx(max(gains.values()))
        want = [base + 0.5 * low((y - base)[(x <= cut) == (v <= cut)]) for v in x]
        np.testing.assert_allclose(model.predict(x[:, None]), want)


def test_thinned_summaries_keep_ranks(monkeypatch):
    from tidegrid.models import histogram_trees as HT

    monkeypatch.setattr(HT, "LEAF_VALUES", 100)
    rng = np.random.default_rng(2)
    parts = [np.sort(rng.normal(size=900)) for _ in range(5)]
    summary = parts[0], np.ones(900, np.int64)
    for part in parts[1:]:
        summary = HT.merged(summary, (part, np.ones(900, np.int64)))
    whole = np.sort(np.concatenate(parts))
    assert summary[1].sum() == 4500 and len(summary[0]) <= 100
    for alpha in (0.1, 0.5, 0.9):
        assert abs((whole <= HT.lower_quantile(summary, alpha)).mean() - alpha) < 0.06


@pytest.mark.parametrize("rows", [1 << 17, 500])
@pytest.mark.parametrize("shape", ["spread", "ties", "one value"])
def test_leaf_quantiles_are_exact_beyond_what_a_pass_keeps(spark, monkeypatch, rows, shape):
    from tidegrid.models import histogram_trees as HT

    monkeypatch.setattr(HT, "LEAF_VALUES", 50)
    monkeypatch.setattr(HT, "TASK_ROWS", rows)
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 2, 4000).astype(float), rng.gamma(2.0, 20.0, 4000)
    y = y.round(1) if shape == "ties" else np.where(rng.random(4000) < 0.97, 7.0, y) if shape == "one value" else y
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    low = lambda v, alpha: np.sort(v)[-(-int(alpha * 10) * len(v) // 10) - 1]
    config = {"n_estimators": 1, "learning_rate": 0.5, "max_depth": 1, "min_samples_leaf": 1, "subsample": 1.0}
    models = Q.fit_candidates(df, target="y", features=["x"], candidates=[config])[0]
    for model, alpha in zip(models.values(), (0.1, 0.5, 0.9)):
        base = low(y, alpha)
        split = len(model.trees[0].value) > 1
        want = [base + 0.5 * low((y - base)[x == v] if split else y - base, alpha) for v in (0.0, 1.0)]
        assert model.base == base and model.predict(np.array([[0.0], [1.0]])).tolist() == want


def test_least_squares_far_from_zero_agrees_with_numpy(spark):
    """Centred sums keep a series at level 4,000 as exact as one around zero."""
    rng = np.random.default_rng(13)
    y = 4000 + np.cumsum(rng.normal(size=600))
    pdf = pd.DataFrame({"y": y[25:], "a": y[24:-1], "b": y[1:-24], "c": y[:-25]})
    row = fit_least_squares(spark.createDataFrame(pdf).repartition(5), y="y", x=["a", "b", "c"]).first()
    design = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.b, pdf.c])
    want, rss, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    np.testing.assert_allclose(row.coefficients, want, rtol=1e-8)
    assert row.rss == pytest.approx(rss[0], rel=1e-9)


@pytest.mark.parametrize("keys", [[], ["s"]])
def test_expanding_fits_equal_a_fit_per_fold(spark, keys):
    """Parts without rows repeat the fit before them; too few rows give none."""
    from tidegrid.models.least_squares import fit_expanding

    rng = np.random.default_rng(14)
    pdf = pd.DataFrame({"s": "u", "part": rng.choice([1, 2, 4, 5, 7], 300), "a": 500 + rng.normal(size=300), "b": rng.normal(size=300)})
    pdf["y"] = 4000 + 2 * pdf.a - pdf.b + rng.normal(size=300)
    few = pd.DataFrame({"s": "v", "part": [3, 3, 4, 5], "a": [1.0, 2, 4, 9], "b": [1.0, 3, 2, 2], "y": [1.0, 2, 3, 4]})
    pdf = pd.concat([pdf, few]) if keys else pdf
    got = {(r.s if keys else "u", r.fold): r for r in fit_expanding(spark.createDataFrame(pdf), y="y", x=["a", "b"], part="part", last_part=6, keys=keys).collect()}
    for s, rows in pdf.groupby("s"):
        for fold in range(1, 7):
            seen = rows[rows.part <= fold]
            assert ((s, fold) in got) == (len(seen) > 3), (s, fold)
            if len(seen) > 3:
                want = np.linalg.lstsq(np.column_stack([np.ones(len(seen)), seen.a, seen.b]), seen.y, rcond=None)[0]
                np.testing.assert_allclose(got[s, fold].coefficients, want, rtol=1e-6, atol=1e-6)
                assert got[s, fold].n == len(seen)


def test_walk_forward_of_a_fit_equals_a_loop_over_folds(spark):
    from tidegrid.plans.walk_forward import walk_forward_least_squares

    rng = np.random.default_rng(15)
    df = series_frame(spark, list(rng.normal(size=150))).withColumn("x", F.col("y") * 0.5 + F.hour("ts"))
    folds = RollingOrigin("2024-01-02 05:00:00", 30, 40, 4)

    def loop(train, scored):
        fit = fit_least_squares(train, y="y", x=["x"])
        b = F.lit(0.0) + fit.select("coefficients").scalar()[0]
        return scored.withColumn("forecast", b + fit.select("coefficients").scalar()[1] * F.col("x"))

    want = {(r.fold, r.ts): r.forecast for r in walk_forward(df, folds, loop, ts="ts").collect()}
    got = {(r.fold, r.ts): r.forecast for r in walk_forward_least_squares(df, folds, y="y", x=["x"], ts="ts").collect()}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_joint_arma_candidates_equal_single_fits(spark):
    from tidegrid.sources.constants import ARMA_CANDIDATES

    rng = np.random.default_rng(16)
    t = np.arange(400)
    values = [None if i in (100, 101, 250) else float(4000 + 20 * np.sin(t[i] / 3.8) + rng.normal()) for i in range(400)]
    df = series_frame(spark, values)
    options = {"value": "y", "ts": "ts", "series_keys": ["series"]}
    fits, residuals = A.fit_arma_candidates(df, ARMA_CANDIDATES, **options)
    joint = {r.candidate: r for r in fits.collect()}
    for c, spec in enumerate(ARMA_CANDIDATES):
        alone, rest = A.fit_seasonal_arma(df, order=spec["order"], seasonal_order=spec["seasonal_order"], **options)
        row = alone.first()
        np.testing.assert_allclose(joint[c].coefficients, row.coefficients, rtol=1e-7, atol=1e-7)
        assert joint[c].aic == pytest.approx(row.aic) and joint[c].n == row.n
        assert residuals.where(F.col("candidate") == c).count() == rest.count() == 400
