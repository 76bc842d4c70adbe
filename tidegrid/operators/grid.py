"""Regular time grids: duplicate collapse, resampling, alignment and missing slots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import chunks as C
from tidegrid.session import cut_lineage, shuffle_partitions

_LOW, _HIGH, _LAST, _SLOT = "_low", "_high", "_last", "_slot"


def _keys_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def _as_list(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def collapse_duplicates(
    df: DataFrame, *, ts: str, value: str | Sequence[str], series_keys: Sequence[str] = ()
) -> DataFrame:
    """Mean of the values that share a time (and series); rows with a NULL key are dropped."""
    keys = [*series_keys, ts]
    return (
        _keys_present(df, keys)
        .groupBy(*keys)
        .agg(*[F.avg(v).alias(v) for v in _as_list(value)])
    )


def _within(
    df: DataFrame, ts: str, step: str, start: Column | None, end: Column | None
) -> DataFrame:
    """Rows whose slot lies in a fixed range, as plain time limits that reach the scan."""
    data_type = C.time_type(df, ts)
    if start is not None:
        df = df.where(F.col(ts) >= C.slot_start(C.grid_position(start, step), step, data_type))
    if end is not None:
        df = df.where(F.col(ts) < C.slot_start(C.grid_position(end, step) + 1, step, data_type))
    return df


def _bounds(
    df: DataFrame, ts: str, keys: list[str], step: str, start: Column | None, end: Column | None
) -> DataFrame:
    """First and last grid position per series, observed or fixed by the caller."""
    fixed_low = None if start is None else C.grid_position(start, step)
    fixed_high = None if end is None else C.grid_position(end, step)
    if not keys and fixed_low is not None and fixed_high is not None:
        one_row = df.sparkSession.range(1)
        return one_row.select(fixed_low.alias(_LOW), fixed_high.alias(_HIGH))
    position = C.grid_position(F.col(ts), step)
    low = F.min(position) if fixed_low is None else F.max(fixed_low)
    high = F.max(position) if fixed_high is None else F.max(fixed_high)
    return df.groupBy(*keys).agg(low.alias(_LOW), high.alias(_HIGH))


def _chunk_edges(bounds: DataFrame) -> DataFrame:
    """Per series and chunk of time: the first and last position inside the bounds."""
    size = F.lit(C.CHUNK_ROWS).cast("bigint")
    low, high = F.col(_LOW), F.col(_HIGH)
    listed = bounds.where(low <= high).withColumn(
        C.CHUNK,
        F.explode(F.sequence(C.floor_div(low, C.CHUNK_ROWS), C.floor_div(high, C.CHUNK_ROWS))),
    )
    first = F.greatest(low, F.col(C.CHUNK) * size)
    last = F.least(high, F.col(C.CHUNK) * size + size - 1)
    return listed.withColumns({C.POSITION: first, _LAST: last}).drop(_LOW, _HIGH)


def _expand(bounds: DataFrame, keys: list[str]) -> DataFrame:
    """All positions between the bounds of each series.

    Chunks are listed first and spread by a fixed number of partitions, so that
    neither one long series nor a small bounds table generates its grid in one task.
    """
    edges = _chunk_edges(bounds)
    spread = edges.repartition(shuffle_partitions(bounds.sparkSession), *keys, C.CHUNK)
    return spread.select(*keys, F.explode(F.sequence(F.col(C.POSITION), F.col(_LAST))).alias(C.POSITION))


def build_grid(
    df: DataFrame,
    *,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """One row per slot and series, over the observed range of each series or a fixed range."""
    data_type = C.time_type(df, ts)
    keys = list(series_keys)
    bounds = _bounds(_keys_present(df, [*keys, ts]), ts, keys, step, start, end)
    return _expand(bounds, keys).select(
        *keys, C.slot_start(F.col(C.POSITION), step, data_type).alias(ts)
    )


def resample_runs(
    df: DataFrame,
    *,
    ts: str,
    value: str | Sequence[str],
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
    unique_times: bool = False,
    materialize: bool = False,
    back: int = 0,
) -> DataFrame:
    """The slots of ``resample_mean`` before the empty ones are listed, dealt by series and chunk.

    A row has its chunk and position, and ``_last``, the last position of its chunk, if it is the chunk's
    first. With ``back``, slots that close to the end of a chunk are there for the next chunk too.
    """
    keys, values = list(series_keys), _as_list(value)
    kept = _keys_present(df, [*keys, ts]).select(*keys, ts, *values)
    if materialize:
        kept = cut_lineage(
            kept if unique_times else collapse_duplicates(kept, ts=ts, value=values, series_keys=keys)
        )
    inside = _within(kept, ts, step, start, end)
    if not unique_times and not materialize:
        inside = collapse_duplicates(inside, ts=ts, value=values, series_keys=keys)
    per_time = inside.select(*keys, C.grid_position(F.col(ts), step).alias(C.POSITION), *values)
    if start is None and end is None and not unique_times and not materialize:
        position = F.col(C.POSITION)
        # Counting the values keeps them in this branch: both branches then read one exchange.
        seen = per_time.groupBy(*keys).agg(
            F.min(position).alias(_LOW), F.max(position).alias(_HIGH), *[F.count(v).alias(f"_n{i}") for i, v in enumerate(values)]
        )
        bounds = seen.where(reduce(and_, [F.col(f"_n{i}") >= 0 for i in range(len(values))]))
    else:
        bounds = _bounds(kept, ts, keys, step, start, end)
    if back:
        placed = C.add_chunks(per_time, F.col(C.POSITION), back=back).drop(C.HOME)
    else:
        placed = per_time.withColumn(C.CHUNK, C.floor_div(F.col(C.POSITION), C.CHUNK_ROWS))
    slots = (
        placed.unionByName(_chunk_edges(bounds), allowMissingColumns=True)
        .groupBy(*keys, C.CHUNK, C.POSITION)
        .agg(*[F.avg(v).alias(v) for v in values], F.max(_LAST).alias(_LAST))
    )
    return slots.repartition(shuffle_partitions(df.sparkSession), *keys, C.CHUNK)


def run_ends(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_last`` as the position before the next row of the chunk; the chunk's last row reaches to its end."""
    window = C.chunk_window(keys)
    # The chunk's first slot has its end; it comes before all others of the chunk.
    return runs.withColumn(_LAST, F.coalesce(F.lead(C.POSITION).over(window) - 1, F.max(_LAST).over(window)))


def run_slots() -> Column:
    """Every slot of a row that ``run_ends`` has marked, as ``_n`` (from 0, the row's own) and ``_slot``."""
    return F.posexplode(F.sequence(F.col(C.POSITION), F.col(_LAST))).alias("_n", _SLOT)


def resample_mean(
    df: DataFrame,
    *,
    ts: str,
    value: str | Sequence[str],
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
    unique_times: bool = False,
    materialize: bool = False,
) -> DataFrame:
    """Mean per left-closed, left-labelled slot, after averaging duplicates.

    It is the mean of the per-time means. Every slot from the first to the last
    of each series appears, an empty one with NULL. The first slot of every chunk
    enters the slot aggregation as a NULL row, and each slot is then followed by the
    empty ones up to the next in its chunk: only slots with rows and chunk starts are
    shuffled, sorted or held in memory, however many empty slots there are.

    ``unique_times=True`` promises at most one row per series and time. The
    duplicate average is then skipped, and raw rows combine to one per slot before
    the only shuffle, at the price of a second pass over the times for the range of each
    series. Otherwise the range is taken from the averaged rows, through the same exchange,
    so the input is read once. A fixed start or end still looks at all times: series without
    a row inside have a range too. ``materialize=True`` stores the averaged rows first, for
    inputs that are costly to compute twice, such as parsed documents.
    """
    data_type = C.time_type(df, ts)
    keys, values = list(series_keys), _as_list(value)
    runs = resample_runs(
        df, ts=ts, value=values, series_keys=keys, step=step, start=start, end=end,
        unique_times=unique_times, materialize=materialize,
    )
    return run_ends(runs, keys).select(*keys, *values, run_slots()).select(
        *keys,
        C.slot_start(F.col(_SLOT), step, data_type).alias(ts),
        *[F.when(F.col("_n") == 0, F.col(v)).alias(v) for v in values],
    )


def align_to_grid(
    df: DataFrame,
    *,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Complete grid LEFT JOIN the observed rows; gaps get NULL in every other column.

    Both sides are hashed by series and time together, so no single series
    gathers in one task.
    """
    keys = list(series_keys)
    grid = build_grid(df, ts=ts, series_keys=keys, step=step, start=start, end=end)
    return grid.join(df, [*keys, ts], "left").select(*df.columns)


def missing_timestamps(
    df: DataFrame,
    *,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Grid slots without any observed row.

    Counted rather than anti-joined: observed rows combine to one per slot before
    the shuffle, and nothing is sorted.
    """
    data_type = C.time_type(df, ts)
    keys = list(series_keys)
    kept = _keys_present(df, [*keys, ts]).select(*keys, ts)
    position = C.grid_position(F.col(ts), step)
    on_grid = C.micros(F.col(ts)) == position * C.step_micros(step)
    seen = kept.where(on_grid).select(*keys, position.alias(C.POSITION), F.lit(1).alias("_seen"))
    grid = _expand(_bounds(kept, ts, keys, step, start, end), keys).withColumn("_seen", F.lit(0))
    return (
        seen.unionByName(grid)
        .groupBy(*keys, C.POSITION)
        .agg(F.max("_seen").alias("_seen"))
        .where(F.col("_seen") == 0)
        .select(*keys, C.slot_start(F.col(C.POSITION), step, data_type).alias(ts))
    )


def timestamp_difference(expected: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct times of ``expected`` that are not in ``observed`` (set difference).

    Repeated observations shrink before the shuffle. Both sides are then dealt to a fixed
    number of partitions, as times compress so well that a size in shuffled bytes would put
    too many of them into one hash aggregate.
    """
    columns = list(on)
    both = expected.select(*columns, F.lit(0).alias("_seen")).unionByName(
        observed.select(*columns).distinct().withColumn("_seen", F.lit(1))
    ).repartition(shuffle_partitions(expected.sparkSession), *columns)
    return both.groupBy(*columns).agg(F.max("_seen").alias("_seen")).where(F.col("_seen") == 0).drop("_seen")


def join_on_time(
    left: DataFrame, right: DataFrame, *, ts: str, keys: Sequence[str] = ()
) -> DataFrame:
    """LEFT JOIN another series or feed on time and any series keys both sides share."""
    return left.join(right, [*keys, ts], "left")
