"""Exact order statistics of groups of any size, by repeated narrowing.

The built-in exact percentile holds every distinct value of a group in one
task, and a ranking window sorts the whole group in one. Here every wanted rank
has an interval of values that holds it, at first from the least to the greatest. A
histogram of ``BINS`` equal bins counts the interval's values in one aggregate with
map-side combine; the bin with the rank becomes the next interval, with its own least
and greatest value as ends. When at most ``LEFT`` values of an interval are left, or
all are equal, they are sorted. All columns and ranks of all groups narrow together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

BINS = 4096
LEFT = 10_000

Rank = tuple[str, Callable[[Column], Column]]


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Rank], *, keys: Sequence[str] = (), left: int = LEFT, bins: int = BINS
) -> DataFrame:
    """k-th smallest non-NULL values per group: one row per group with ``ranks`` as columns.

    ``ranks`` maps an output name to a column and a function from the column's number of
    values in the group to a rank k. A rank of less than 1 or beyond that number gives
    NULL. ``n`` is a map from column to number of values. Groups without any value are
    absent; without keys there is always one row. NULL keys form groups of their own.
    """
    keys, columns = list(keys), list(dict.fromkeys(column for column, _ in ranks.values()))
    entries = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    group = [f"_key{i}" for i in range(len(keys))]
    values = df.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.inline(entries)).where("_v IS NOT NULL")
    values = cut_lineage(values)
    by = [*group, "_c"]

    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(columns.index(column)).alias("c"), rank(F.col("n")).cast("bigint").alias("k"))
        for name, (column, rank) in ranks.items()
    ])
    mine = F.filter(wanted, lambda r: (r["c"] == F.col("_c")) & (r["k"] >= 1) & (r["k"] <= F.col("n")))
    ranked = F.transform(mine, lambda r: F.struct(r["name"].alias("name"), r["k"].alias("k")))
    sizes = cut_lineage(sizes.withColumn("_ranks", ranked))
    state = sizes.withColumn("_left", F.col("n")).drop("n")
    while state.where((F.col("_left") > left) & (F.col("_lo") < F.col("_hi"))).limit(1).count():
        state = cut_lineage(_narrowed(values, state, by, left, bins))

    rest = _inside(values, state.where("_lo < _hi"), by)
    at = F.transform("_ranks", lambda r: F.struct(r["name"].alias("name"), F.element_at("_sorted", r["k"].cast("int")).alias("value")))
    found = rest.groupBy(*by, "_lo", "_ranks").agg(F.sort_array(F.collect_list("_v")).alias("_sorted")).select(*group, at.alias("_found"))
    equal = F.transform("_ranks", lambda r: F.struct(r["name"].alias("name"), F.col("_lo").alias("value")))
    found = found.unionByName(state.where("_lo = _hi").select(*group, equal.alias("_found")))
    picked = found.select(*group, F.explode("_found").alias("_f"))
    outputs = [F.max(F.when(F.col("_f.name") == name, F.col("_f.value"))).alias(name) for name in ranks]
    counts = sizes.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct(F.element_at(F.array(*map(F.lit, columns)), F.col("_c") + 1), "n"))).alias("n")
    )
    every = counts.select(*group, "n", F.lit(None).alias("_f")).unionByName(picked, allowMissingColumns=True)
    return every.groupBy(*group).agg(F.first("n", ignorenulls=True).alias("n"), *outputs).withColumnsRenamed(dict(zip(group, keys)))


def _inside(values: DataFrame, state: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values within the intervals of their group and column.

    The intervals are narrow: adaptive execution broadcasts them if it measures them small,
    and otherwise splits the parts of groups that hold many values.
    """
    renamed = state.withColumnsRenamed({c: f"_of{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in by]
    joined = values.join(renamed, [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))])
    return joined.drop(*[f"_of{c}" for c in by])


def _narrowed(values: DataFrame, state: DataFrame, by: Sequence[str], left: int, bins: int) -> DataFrame:
    """Intervals of the bins that hold the ranks; finished intervals as they are."""
    open_ = (F.col("_left") > left) & (F.col("_lo") < F.col("_hi"))
    # Halves keep the width finite; the bin never falls as the value grows, so bins are intervals too.
    place = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins
    # The ends have bins of their own, so an interval always gets shorter, also with infinite ends.
    inner = F.floor(F.nanvl(place, F.lit(0.0))).cast("int")
    number = F.when(F.col("_v") == F.col("_lo"), F.lit(-1)).when(F.col("_v") == F.col("_hi"), F.lit(bins + 1)).otherwise(inner)
    binned = _inside(values, state.where(open_), by).withColumn("_bin", number)
    histogram = binned.groupBy(*by, "_lo", "_ranks", "_bin").agg(
        F.count(F.lit(1)).alias("_left"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    order = Window.partitionBy(*by, "_lo").orderBy("_bin")  # at most one row per bin
    summed = histogram.withColumn("_upto", F.sum("_left").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.col("_upto") - F.col("_left")
    here = F.filter("_ranks", lambda r: (r["k"] > before) & (r["k"] <= F.col("_upto")))
    moved = F.transform(here, lambda r: F.struct(r["name"].alias("name"), (r["k"] - before).alias("k")))
    narrowed = summed.withColumn("_ranks", moved).where(F.size("_ranks") > 0).select(
        *by, F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), "_ranks", "_left"
    )
    return narrowed.unionByName(state.where(~open_))


def order_statistic(
    df: DataFrame, value: str, ranks: Mapping[str, Callable[[Column], Column]], *, keys: Sequence[str] = (), left: int = LEFT
) -> DataFrame:
    """``order_statistics`` of one column, with its number of values as ``n``."""
    found = order_statistics(df, {name: (value, rank) for name, rank in ranks.items()}, keys=keys, left=left)
    return found.withColumn("n", F.coalesce(F.try_element_at("n", F.lit(value)), F.lit(0)))


def medians(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = (), left: int = LEFT) -> DataFrame:
    """Exact medians per group under the columns' names; the mean of the two middle values when their number is even."""
    ranks = {}
    for i, c in enumerate(columns):
        ranks[f"_lower{i}"] = (c, lambda n: F.floor((n + 1) / 2))
        ranks[f"_upper{i}"] = (c, lambda n: F.floor(n / 2) + 1)
    found = order_statistics(df, ranks, keys=keys, left=left)
    return found.select(*keys, *[((F.col(f"_lower{i}") + F.col(f"_upper{i}")) / 2).alias(c) for i, c in enumerate(columns)])


def median(df: DataFrame, value: str, *, keys: Sequence[str] = (), left: int = LEFT) -> DataFrame:
    """Exact median per group, as ``median``."""
    return medians(df, [value], keys=keys, left=left).withColumnRenamed(value, "median")


def approximate_median(
    df: DataFrame, value: str, *, keys: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """One-pass median with relative rank error at most ``1 / accuracy``."""
    return df.groupBy(*keys).agg(
        F.percentile_approx(value, 0.5, accuracy).alias("median")
    )
