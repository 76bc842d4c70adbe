"""Writers: tables, split-partitioned tables, raw snapshots and run lineage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidegrid.functions.scalars import redact_token


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and no index, replacing what was there."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON record per row."""
    df.write.mode("overwrite").json(path)


def write_snapshot(documents: DataFrame, path: str) -> None:
    """Raw documents verbatim with their origin, kept before any parsing."""
    documents.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str, by: tuple[str, ...] = ("horizon", "split")) -> None:
    """One folder per horizon and split, so readers prune to the folders they need.

    Rows are rebalanced by folder first: adaptive execution cuts large folders into
    files of its advisory size, and no task writes a small file into every folder.
    """
    balanced = df.hint("rebalance", *[F.col(c) for c in by])
    balanced.write.mode("overwrite").partitionBy(*by).parquet(path)


def lineage_row(
    df: DataFrame, *, ts: str, source: str, parameters: Mapping[str, str] | None = None,
    url: str | None = None,
) -> DataFrame:
    """Provenance of a table: source, parameters, row count, time range, columns, stamp."""
    options = {k: str(v) for k, v in (parameters or {}).items()}
    pairs = [F.lit(x) for pair in options.items() for x in pair]
    parameter_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(ts).alias("start_utc"), F.max(ts).alias("end_utc")
    ).select(
        F.lit(source).alias("source"),
        redact_token(F.lit(url).cast("string")).alias("resolved_url"),
        parameter_map.alias("parameters"),
        "row_count",
        "start_utc",
        "end_utc",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.current_timestamp().alias("generated_at_utc"),
    )


def write_with_lineage(df: DataFrame, path: str, *, ts: str, by: tuple[str, ...] = ()) -> dict[str, object]:
    """Write Parquet, split by ``by`` if given, and return its row count and time range, measured during the write."""
    seen = Observation("lineage")
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("row_count"),
        F.min(ts).alias("start_utc"),
        F.max(ts).alias("end_utc"),
    )
    if by:
        write_splits(watched, path, by)
    else:
        write_parquet(watched, path)
    return dict(seen.get)
