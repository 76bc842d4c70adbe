"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per vertex and a join, so no neighbourhood is ever collected; a hub's
rows are an ordinary skewed join. Edges shrink towards stars around the smallest vertex of each
component, in a number of rounds that grows with the logarithm of the component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex links itself and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex with an edge, roots included: root is the smallest id of its component.

    ``edges`` has columns u and v, not null. Loops and repeats are allowed.
    """
    current = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, u))")).first())
    before = sign(current)
    while True:
        current = stored(_small_star(_large_star(current)), "edges")
        after = sign(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("id"), F.col("v").alias("root")).union(current.select("v", "v").distinct())
