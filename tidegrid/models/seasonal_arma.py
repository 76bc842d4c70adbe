"""Seasonal ARMA by two-stage least squares (Hannan and Rissanen 1982).

A long autoregression gives residuals; a second regression on lags of the series
and of those residuals gives the ARMA coefficients. Numbers differ from a
maximum-likelihood fit. Everything is per series: covariances are distributed and
centred, all candidate orders share the passes of both stages, and the recursive
forecast runs step by step over arrays of many series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.models.least_squares import fit_least_squares, linear_value
from tidegrid.operators import chunks as C
from tidegrid.operators.grid import align_to_grid
from tidegrid.operators.metrics import point_metrics
from tidegrid.operators.splits import before_test
from tidegrid.session import cut_lineage
from tidegrid.sources.constants import ARMA_CANDIDATES


def arma_lags(order: Sequence[int], seasonal_order: Sequence[int]) -> tuple[list[int], list[int]]:
    """Lags of the autoregressive and the moving-average part, seasonal products included."""
    p, d, q = order
    sp, sd, sq, s = seasonal_order
    if d not in (0, 1) or sd != 0:
        raise ValueError("only d in (0, 1) and no seasonal differencing")

    def lags(short: int, seasonal: int) -> list[int]:
        found = {s * i + j for i in range(seasonal + 1) for j in range(short + 1)} - {0}
        return sorted(found)

    return lags(p, sp), lags(q, sq)


def long_lags(order: Sequence[int], seasonal_order: Sequence[int]) -> list[int]:
    """Lags of the first-stage autoregression: a few steps, and a few around the season."""
    m, s = max(order[0], order[2]) + 2, seasonal_order[3]
    short = set(range(1, m + 1))
    return sorted(short | ({s + j for j in range(m)} if seasonal_order[0] + seasonal_order[2] else set()))


def _padded(columns: Sequence[Column], width: int) -> Column:
    """Regressors of one candidate; zeros after them get the coefficient 0."""
    return F.array(*columns, *[F.lit(0.0)] * (width - len(columns)))


def fit_arma_candidates(
    train: DataFrame,
    specs: Sequence[Mapping[str, object]],
    *,
    value: str,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
) -> tuple[DataFrame, DataFrame]:
    """Fit all candidate orders to every series, each stage of all of them in one pass.

    The series are put on their complete grid first (NULL at gaps). Returns, per series and
    ``candidate`` (the number in ``specs``), the coefficients with AIC, and the series with
    ``_z`` (differenced value) and ``_e`` (first-stage residual) for forecasting.
    """
    C.time_type(train, ts)
    keys = list(series_keys)
    group = [*keys, "candidate"]
    parts = [(*arma_lags(s["order"], s["seasonal_order"]), s["order"][1], long_lags(s["order"], s["seasonal_order"])) for s in specs]
    base = align_to_grid(train.select(*keys, ts, value), ts=ts, series_keys=keys, step=step)

    needed = sorted({k + extra for _, _, d, first in parts for k in (0, *first) for extra in range(d + 1)})
    placed = C.add_chunks(base, C.grid_position(F.col(ts), step), back=max(needed))
    window = C.chunk_window(keys)
    lagged = C.drop_halo(placed.withColumns({f"_y{k}": C.at_step(F.col(value).cast("double"), -k, window) for k in needed}))
    width = max(len(first) for *_, first in parts)
    z = lambda k, d: F.col(f"_y{k}") - F.col(f"_y{k + 1}") if d else F.col(f"_y{k}")
    entries = F.array(*[
        F.struct(F.lit(c).alias("candidate"), z(0, d).alias("_z"), _padded([z(k, d) for k in first], width).alias("_x"))
        for c, (_, _, d, first) in enumerate(parts)
    ])
    stage1 = lagged.select(*keys, ts, value, F.inline(entries)).select(
        *group, ts, value, "_z", *[F.col("_x")[i].alias(f"_long{i}") for i in range(width)]
    )
    names1 = [f"_long{i}" for i in range(width)]
    fit1 = fit_least_squares(stage1, y="_z", x=names1, keys=group).select(*group, "coefficients")
    residuals = C.keyed_lookup(stage1, fit1, group).select(
        *group, ts, value, "_z", (F.col("_z") - linear_value(names1)).alias("_e")
    )
    residuals = cut_lineage(residuals)

    ar_all, ma_all = (sorted({k for part in parts for k in part[side]}) for side in (0, 1))
    chunked = C.add_chunks(residuals, C.grid_position(F.col(ts), step), back=max([*ar_all, *ma_all]))
    window = C.chunk_window(group)
    lags = {f"_ar{k}": C.at_step("_z", -k, window) for k in ar_all} | {f"_ma{k}": C.at_step("_e", -k, window) for k in ma_all}
    width = max(len(ar) + len(ma) for ar, ma, *_ in parts)
    chosen = F.array(*[_padded([F.col(f"_ar{k}") for k in ar] + [F.col(f"_ma{k}") for k in ma], width) for ar, ma, *_ in parts])
    stage2 = C.drop_halo(chunked.withColumns(lags)).withColumn("_x", chosen[F.col("candidate")])
    names2 = [f"_x{i}" for i in range(width)]
    fit2 = fit_least_squares(stage2.select(*group, "_z", *[F.col("_x")[i].alias(c) for i, c in enumerate(names2)]), y="_z", x=names2, keys=group)
    sizes = F.array(*[F.lit(len(ar) + len(ma)) for ar, ma, *_ in parts])[F.col("candidate")]
    n = F.col("n")
    aic = n * F.log(F.greatest(F.col("rss"), F.lit(1e-300)) / n) + 2 * (sizes + 2)
    return fit2.withColumns({"aic": aic, "coefficients": F.slice("coefficients", F.lit(1), sizes + 1)}), residuals


def fit_seasonal_arma(
    train: DataFrame,
    *,
    value: str,
    ts: str,
    order: Sequence[int],
    seasonal_order: Sequence[int],
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
) -> tuple[DataFrame, DataFrame]:
    """``fit_arma_candidates`` of a single order."""
    spec = {"order": order, "seasonal_order": seasonal_order}
    fits, residuals = fit_arma_candidates(train, [spec], value=value, ts=ts, series_keys=series_keys, step=step)
    return fits.drop("candidate"), residuals.drop("candidate")


def _paths(ar: Sequence[int], ma: Sequence[int], d: int):
    """Forecasts of many series: one step after the other, each in constant time."""

    @F.pandas_udf("array<double>")
    def path(z: pd.Series, e: pd.Series, mean: pd.Series, level: pd.Series, coefficients: pd.Series, steps: pd.Series) -> pd.Series:
        out = []
        for z0, e0, usual, known, b, n in zip(z, e, mean, level, coefficients, steps):
            past, shocks = np.empty(len(z0) + n), np.asarray(e0, float)
            past[: len(z0)] = z0
            for h in range(n):
                now = len(z0) + h
                total = b[0]
                for i, k in enumerate(ar, start=1):
                    total += b[i] * (past[now - k] if now >= k else usual)
                for i, k in enumerate(ma, start=1 + len(ar)):
                    if h < k <= now:  # later shocks are zero
                        total += b[i] * shocks[now - k]
                past[now] = total
            ahead = past[len(z0):]
            out.append(known + np.cumsum(ahead) if d else ahead)
        return pd.Series(out)

    return path


def forecast_seasonal_arma(
    fits: DataFrame,
    residuals: DataFrame,
    *,
    value: str,
    ts: str,
    order: Sequence[int],
    seasonal_order: Sequence[int],
    steps: int,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
) -> DataFrame:
    """Recursive forecast up to ``steps`` steps after the last row of all series.

    Every series runs from its own last row to that common end. The state holds as
    many recent values as the longest lag. A gap in it counts as the recent mean, a
    missing residual as zero. With a difference, the path starts from the last known
    value of the series, however long ago; a fitted series without one fails the job.
    """
    keys, d = list(series_keys), order[1]
    ar, ma = arma_lags(order, seasonal_order)
    memory = max([*ar, *ma])
    data_type = C.time_type(residuals, ts)
    newest = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    recent = residuals.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= memory)
    known = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(ts)))
    last = residuals.groupBy(*keys).agg(
        known.cast("double").alias("_level"), F.max(C.grid_position(F.col(ts), step)).alias("_origin")
    )
    end = residuals.agg(F.max(C.grid_position(F.col(ts), step)) + steps).scalar()
    state = recent.groupBy(*keys).agg(
        F.coalesce(F.avg("_z"), F.lit(0.0)).alias("_mean"),
        F.sort_array(F.collect_list(F.struct(ts, "_z", "_e"))).alias("_rows"),
    )
    ready = fits.select(*keys, "coefficients")
    if keys:
        joined = state.join(last, keys).join(ready, keys)
    else:
        joined = C.keyed_lookup(state, last, []).withColumn("coefficients", ready.scalar())
        joined = joined.where(F.col("coefficients").isNotNull())
    no_level = F.raise_error(F.lit("a differenced series has no known value to start from")).cast("double")
    z0 = F.transform("_rows", lambda r: F.coalesce(r["_z"], F.col("_mean")))
    e0 = F.transform("_rows", lambda r: F.coalesce(r["_e"], F.lit(0.0)))
    level = F.coalesce(F.col("_level"), no_level) if d else F.lit(0.0)
    path = _paths(ar, ma, d)(z0, e0, F.col("_mean"), level, F.col("coefficients"), (end - F.col("_origin")).cast("int"))
    walked = joined.select(*keys, "_origin", path.alias("_path"))
    return walked.select(*keys, "_origin", F.posexplode("_path").alias("_i", "forecast")).select(
        *keys,
        C.slot_start(F.col("_origin") + F.col("_i") + 1, step, data_type).alias(ts),
        (F.col("_i") + 1).alias("lead_steps"),
        "forecast",
    )


def _steps_to_end(train: DataFrame, scored: DataFrame, ts: str, step: str) -> int:
    """Steps from the last time of ``train`` to the last time of ``scored``, over all series."""
    last = lambda df: df.agg(F.max(C.grid_position(F.col(ts), step))).first()[0]
    known, end = last(train), last(scored)
    return 1 if known is None or end is None else max(1, end - known)


def _run(
    train: DataFrame, scored: DataFrame, specs: Sequence[Mapping[str, object]], common: dict, steps: int | None
) -> tuple[DataFrame, DataFrame]:
    """Fits of all candidates, and the scored rows with each one's forecast."""
    if steps is None:
        steps = _steps_to_end(train, scored, common["ts"], common["step"])
    fits, residuals = fit_arma_candidates(train, specs, **common)
    fits = cut_lineage(fits)
    keys, parts = list(common["series_keys"]), []
    for c, spec in enumerate(specs):
        mine = F.col("candidate") == c
        forecasts = forecast_seasonal_arma(
            fits.where(mine), residuals.where(mine), steps=steps, order=spec["order"], seasonal_order=spec["seasonal_order"], **common
        )
        joined = scored.join(forecasts, [*keys, common["ts"]], "left")
        parts.append(joined.withColumns({"candidate": F.lit(c), "model_name": F.lit(spec["name"])}))
    return fits, reduce(DataFrame.unionByName, parts)


def _candidate_results(train: DataFrame, scored: DataFrame, specs: Sequence[Mapping[str, object]], common: dict, steps: int | None) -> dict[str, tuple]:
    """Error, AIC and rows without a forecast by candidate."""
    value = common["value"]
    fits, joined = _run(train, scored, specs, common, steps)
    lost = F.count_if(F.col(value).isNotNull() & F.col("forecast").isNull()).alias("unforecast_rows")
    metrics = point_metrics(joined, actual=value, forecast="forecast", by=["candidate"]).drop("row_count")
    table = metrics.join(joined.groupBy("candidate").agg(lost), "candidate").join(
        fits.groupBy("candidate").agg(F.sum("aic").alias("aic")), "candidate", "left"
    )
    return {specs[r.candidate]["name"]: (r.mae, r.rmse, r.aic, r.unforecast_rows, None) for r in table.collect()}


def search_orders(
    df: DataFrame,
    *,
    value: str,
    ts: str,
    steps: int | None = None,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    candidates: Sequence[Mapping[str, object]] = ARMA_CANDIDATES,
) -> tuple[Mapping[str, object], DataFrame]:
    """Fit all candidates on train together, score validation, keep the lowest RMSE (first wins ties).

    Candidates that leave fewer known rows without a forecast come first; their number is
    reported. A candidate that fails is recorded with its error; all failing is an error.
    Without ``steps``, forecasts reach the last validation row.
    """
    common = {"value": value, "ts": ts, "series_keys": tuple(series_keys), "step": step}
    table = cut_lineage(df.select(*series_keys, ts, value, "split"))
    train = table.where(F.col("split") == "train").drop("split")
    validation = table.where(F.col("split") == "validation").drop("split")
    found: dict[str, tuple] = {}
    try:
        found = _candidate_results(train, validation, candidates, common, steps)
    except (PySparkException, ValueError):
        # One candidate fails them all: find out which.
        for spec in candidates:
            try:
                found |= _candidate_results(train, validation, [spec], common, steps)
            except (PySparkException, ValueError) as error:
                found[spec["name"]] = (None, None, None, None, str(error).split("\n")[0])
    unfitted = (None, None, None, None, "no series could be fitted")
    results = [(s["name"], *found.get(s["name"], unfitted)) for s in candidates]
    results = [r if r[5] or None not in r[2:4] else (r[0], *unfitted) for r in results]
    ranked = [(r[4], r[2], c) for c, r in enumerate(results) if r[5] is None]
    if not ranked:
        raise RuntimeError(f"no seasonal ARMA candidate could be fitted: {results}")
    summary = df.sparkSession.createDataFrame(
        results,
        "model_name string, mae double, rmse double, aic double, unforecast_rows bigint, error string",
    )
    return candidates[min(ranked)[2]], summary


def refit_and_score_test(
    df: DataFrame,
    spec: Mapping[str, object],
    *,
    value: str,
    ts: str,
    steps: int | None = None,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
) -> DataFrame:
    """Refit on train and validation, forecast the test span; actuals may be missing.

    Without ``steps``, forecasts reach the last test row. Every test row stays; rows of a series that could not be fitted have no forecast.
    """
    common = {"value": value, "ts": ts, "series_keys": tuple(series_keys), "step": step}
    test = df.where(F.col("split") == "test").select(*series_keys, ts, value)
    return _run(before_test(df), test, [spec], common, steps)[1].drop("candidate")
