"""History features: lags and trailing statistics of a gap-filled series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegrid.operators import chunks as C
from tidegrid.operators import grid as G

# Lags and trailing window of the modelling table, in steps.
LAGS = (1, 24, 48, 168)
ROLLING_STEPS = 24


def history_columns(
    value: str,
    window: WindowSpec,
    *,
    prefix: str,
    lags: Sequence[int] = LAGS,
    rolling: Sequence[int] = (ROLLING_STEPS,),
    exclude_current: bool = False,
) -> dict[str, Column]:
    """Lag, trailing mean and trailing sample deviation columns over one window order.

    Frames are ranges of positions: steps without a row count as missing. A trailing
    statistic is NULL unless its whole frame is present.
    """
    y = F.col(value)
    columns = {f"{prefix}_lag_{k}": C.at_step(y, -k, window) for k in lags}
    shift = 1 if exclude_current else 0
    for n in rolling:
        frame = window.rangeBetween(1 - n - shift, -shift)
        complete = F.count(y).over(frame) >= n
        columns[f"{prefix}_rollmean_{n}"] = F.when(complete, F.avg(y).over(frame))
        columns[f"{prefix}_rollstd_{n}"] = F.when(complete, F.stddev_samp(y).over(frame))
    return columns


def history_reach(lags: Sequence[int], rolling: Sequence[int]) -> int:
    return max([0, *lags, *rolling])


def add_history_features(
    df: DataFrame,
    *,
    value: str = "load_mw",
    ts: str = "timestamp_utc",
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    prefix: str = "load",
    lags: Sequence[int] = LAGS,
    rolling: Sequence[int] = (ROLLING_STEPS,),
    exclude_current: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """All lags and trailing statistics in one shuffle and one sort; steps may be absent.

    With ``exclude_current=True`` trailing frames end one step earlier.
    """
    C.time_type(df, ts)
    chunked = C.add_chunks(
        df, C.grid_position(F.col(ts), step), back=history_reach(lags, rolling), rows=rows
    )
    added = history_columns(
        value,
        C.chunk_window(series_keys),
        prefix=prefix,
        lags=lags,
        rolling=rolling,
        exclude_current=exclude_current,
    )
    return C.drop_halo(chunked.withColumns(added))


def resample_with_history(
    df: DataFrame,
    *,
    value: str,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    prefix: str = "load",
    lags: Sequence[int] = LAGS,
    rolling: Sequence[int] = (ROLLING_STEPS,),
) -> DataFrame:
    """``resample_mean`` and ``add_history_features`` in one, for series with many empty slots and short lags.

    Windows run over the slots with rows only: an empty slot has no trailing statistic, and its
    lags are values of slots within the longest lag of the one before it, which come along as
    an array. So the complete grid is neither shuffled nor sorted.
    """
    data_type, keys = C.time_type(df, ts), list(series_keys)
    reach = max([0, *lags])
    window = C.chunk_window(keys)
    trailing = history_columns(value, window, prefix=prefix, lags=(), rolling=rolling)
    earlier = F.array(*[C.at_step(value, -k, window) for k in range(1, reach + 1)]).cast("array<double>")
    runs = G.resample_runs(
        df, ts=ts, value=value, series_keys=keys, step=step, back=history_reach(lags, rolling)
    )
    own = F.col(C.POSITION) >= F.col(C.CHUNK) * F.lit(C.CHUNK_ROWS).cast("bigint")
    runs = G.run_ends(runs, keys).withColumns(trailing | {"_earlier": earlier}).where(own)
    n, observed = F.col("_n"), F.col("_n") == 0

    def lag(k: int) -> Column:
        return F.when(n == k, F.col(value)).when(n < k, F.get("_earlier", k - 1 - n))

    return runs.select(*keys, value, *trailing, "_earlier", G.run_slots()).select(
        *keys,
        C.slot_start(F.col("_slot"), step, data_type).alias(ts),
        F.when(observed, F.col(value)).alias(value),
        *[lag(k).alias(f"{prefix}_lag_{k}") for k in lags],
        *[F.when(observed, F.col(c)).alias(c) for c in trailing],
    )
