"""Chunked time: the unit of parallelism for every window in this package.

A window partitioned by series alone puts a whole series into one task, and a
window over a single unlabelled series puts everything there. Here time is cut
into chunks of ``CHUNK_ROWS`` grid steps, windows are partitioned by series and
chunk, and each chunk also receives the few rows before and after it that its
windows look at (its halo). A task then sorts at most ``CHUNK_ROWS`` plus the
halo per group, whatever the length or the share of a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 8192
SUPER_CHUNKS = 4096

POSITION = "_position"
CHUNK = "_chunk"
HOME = "_home"

# Microseconds per time unit.
UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}


def step_micros(step: str) -> int:
    """Length of a step such as ``"1 hour"`` or ``"15 minutes"`` in microseconds."""
    count, _, unit = step.strip().partition(" ")
    micros = UNIT_MICROS.get(unit.strip().removesuffix("s"))
    if not count.isdigit() or int(count) == 0 or micros is None:
        raise ValueError(f"not a fixed-length step: {step!r}")
    return int(count) * micros


def floor_div(value: Column, divisor: int) -> Column:
    """Integer division rounding down, also for values before the epoch."""
    d = F.lit(divisor).cast("bigint")
    return F.call_function("div", value - F.pmod(value, d), d)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_type(df: DataFrame, ts: str) -> T.DataType:
    """Type of the time column; a zone-less type needs a session in UTC to count micros exactly."""
    data_type = df.schema[ts].dataType
    if not isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{ts} is {data_type.simpleString()}, expected a timestamp")
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the session time zone must be UTC, it is {zone}")
    return data_type


def grid_position(ts: Column, step: str) -> Column:
    """Index of the grid slot that holds ``ts``, counted from the epoch."""
    return floor_div(micros(ts), step_micros(step))


def slot_start(position: Column, step: str, data_type: T.DataType) -> Column:
    """Left edge of a grid slot."""
    return F.timestamp_micros(position * F.lit(step_micros(step)).cast("bigint")).cast(data_type)


def add_chunks(
    df: DataFrame, position: Column, *, back: int = 0, ahead: int = 0, rows: int | None = None
) -> DataFrame:
    """Assign rows to chunks, copying edge rows into the neighbours whose windows reach them.

    ``_home`` marks the one copy of each row that results are taken from. Rows
    without a position have no place in time and are dropped.
    """
    size = rows or CHUNK_ROWS
    placed = df.withColumn(POSITION, position)
    p = F.col(POSITION)
    if back == 0 and ahead == 0:
        return (
            placed.where(p.isNotNull())
            .withColumn(CHUNK, floor_div(p, size))
            .withColumn(HOME, F.lit(True))
        )
    reach = F.sequence(floor_div(p - ahead, size), floor_div(p + back, size))
    return placed.withColumn(CHUNK, F.explode(reach)).withColumn(
        HOME, F.col(CHUNK) == floor_div(p, size)
    )


def chunk_window(series_keys: Sequence[str] = (), *, descending: bool = False) -> WindowSpec:
    order = F.col(POSITION).desc() if descending else F.col(POSITION).asc()
    return Window.partitionBy(*series_keys, CHUNK).orderBy(order)


def at_step(value: Column | str, steps: int, window: WindowSpec) -> Column:
    """The value exactly ``steps`` grid steps ahead (behind if negative); NULL where that row is absent.

    The frame is a range of positions, so absent rows and rows with NULL give the same, and
    nothing depends on where chunks begin.
    """
    return F.max(value).over(window.rangeBetween(steps, steps))


def drop_halo(df: DataFrame) -> DataFrame:
    """Keep one copy of each row and remove the helper columns."""
    return df.where(F.col(HOME)).drop(POSITION, CHUNK, HOME)


def scan_chunks(
    summary: DataFrame,
    keys: Sequence[str],
    *,
    sums: Sequence[str] = (),
    earlier: Sequence[str] = (),
    later: Sequence[str] = (),
) -> DataFrame:
    """Carry per-chunk summaries along the chunks of every series; one row per series and chunk.

    ``sums`` become totals of the chunks before, ``earlier`` the nearest value before that is
    not NULL, ``later`` the nearest one after. Chunks form super-chunks of ``SUPER_CHUNKS``: a
    window runs over the chunks of one super-chunk, and one over the super-chunks of a series,
    each of which stands for ``CHUNK_ROWS * SUPER_CHUNKS`` steps (over a thousand years of hours).
    """
    keys, upper = list(keys), "_super"
    names = [*sums, *earlier, *later]
    placed = summary.select(*keys, CHUNK, floor_div(F.col(CHUNK), SUPER_CHUNKS).alias(upper), *names)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(CHUNK))
    tops = placed.groupBy(*keys, upper).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, known(c)).alias(c) for c in earlier],
        *[F.min_by(c, known(c)).alias(c) for c in later],
    )

    def carried(window: WindowSpec, backwards: WindowSpec) -> dict[str, Column]:
        before = window.rowsBetween(Window.unboundedPreceding, -1)
        after = backwards.rowsBetween(Window.unboundedPreceding, -1)
        return (
            {c: F.sum(c).over(before) for c in sums}
            | {c: F.last(c, ignorenulls=True).over(before) for c in earlier}
            | {c: F.last(c, ignorenulls=True).over(after) for c in later}
        )

    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    outer = carried(across.orderBy(upper), across.orderBy(F.desc(upper)))
    within = Window.partitionBy(*keys, upper)
    inner = carried(within.orderBy(CHUNK), within.orderBy(F.desc(CHUNK)))
    above = tops.select(*keys, upper, *[value.alias(f"_above_{c}") for c, value in outer.items()])
    joined = placed.select(*keys, CHUNK, upper, *[value.alias(c) for c, value in inner.items()]).join(above, [*keys, upper])
    zero = F.lit(0)
    return joined.select(
        *keys,
        CHUNK,
        *[(F.coalesce(c, zero) + F.coalesce(f"_above_{c}", zero)).alias(c) for c in sums],
        *[F.coalesce(c, f"_above_{c}").alias(c) for c in (*earlier, *later)],
    )


def add_row_number(
    df: DataFrame,
    *,
    ts: str,
    series_keys: Sequence[str] = (),
    step: str = "1 hour",
    name: str = "row_number",
    rows: int | None = None,
) -> DataFrame:
    """1-based position of each row in its series, without sorting the series in one task.

    Rows are numbered inside their chunk of time and shifted by the number of
    rows in earlier chunks. A series has at most one row per step (resample first),
    so a chunk never holds more than ``CHUNK_ROWS`` rows; some steps may be absent.
    """
    time_type(df, ts)
    size = rows or CHUNK_ROWS
    keys = list(series_keys)
    chunked = df.withColumn(CHUNK, floor_div(grid_position(F.col(ts), step), size))
    counts = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_offset"))
    offsets = scan_chunks(counts, keys, sums=["_offset"])
    local = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(ts))
    return (
        chunked.withColumn("_local", local)
        .join(offsets, [*keys, CHUNK], "left")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .select(*df.columns, name)
    )


def keyed_lookup(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join per-key values to ``big``, also for keys that hold most rows.

    ``small`` has one row per key. Adaptive execution broadcasts it if it measures it within
    its threshold, and otherwise splits the parts of hot keys by their measured size. Without
    keys the single row comes as a scalar subquery.
    """
    values = [c for c in small.columns if c not in keys]
    if not keys:
        row = small.select(F.struct(*values).alias("_row")).scalar()
        return big.withColumn("_row", row).select(*big.columns, *[F.col(f"_row.{v}") for v in values])
    return big.join(small, list(keys), "left").select(*big.columns, *values)
