"""Guarded table scans, JSON documents and resolution of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalars import nan_to_null

RUN_METADATA_SCHEMA = (
    "run_generated_at_utc string, datasets array<struct<dataset_name string, document_type string, "
    "process_type string, area_param_name string, area_code string, period_start string, "
    "period_end string, downloaded_at_utc string, resolved_url string, raw_xml_path string, "
    "normalized_csv_path string, row_count bigint, note string>>"
)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """Fail when there is no row; it reads at most one."""
    if df.isEmpty():
        raise ValueError(f"dataset is empty: {name}")
    return df


def read_table(
    spark: SparkSession,
    path: str,
    *,
    schema: str | T.StructType | None = None,
    format: str = "parquet",
    required: bool = True,
) -> DataFrame:
    """Parquet or CSV with a header, with floating NaN turned into NULL.

    Pass a schema for CSV: without one Spark reads the files twice to infer it.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if format == "csv":
        options = {"header": True} if schema is not None else {"header": True, "inferSchema": True}
        df = reader.options(**options).csv(path)
    elif format == "parquet":
        df = reader.parquet(path)
    else:
        raise ValueError(f"unknown table format: {format}")
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if floats:
        df = df.withColumns({c: nan_to_null(F.col(c)) for c in floats})
    return require_rows(df, path) if required else df


def read_json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Each JSON file as one row ``(path, payload)`` with an open-schema payload."""
    text = spark.read.text(path, wholetext=True)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("payload")
    )


def latest_run(spark: SparkSession, folder: str, pattern: str) -> str:
    """Last path in lexicographic order among the files that match; only paths are read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    )
    path = files.agg(F.max("path")).first()[0]
    if path is None:
        raise FileNotFoundError(f"no run metadata like {pattern} in {folder}")
    return path


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_METADATA_SCHEMA).json(path, multiLine=True)


def dataset_entries(metadata: DataFrame) -> DataFrame:
    """The last entry of every dataset of a run, one row each."""
    entries = metadata.select(F.posexplode("datasets").alias("pos", "d"))
    return entries.groupBy("d.dataset_name").agg(F.max_by("d", "pos").alias("_last")).select("_last.*")


def dataset_paths(metadata: DataFrame, names: list[str]) -> dict[str, str]:
    """Artifact path of each named dataset; the last entry wins, an absent one is an error."""
    chosen = dataset_entries(metadata).where(F.col("dataset_name").isin(names))
    found = {row["dataset_name"]: row["normalized_csv_path"] for row in chosen.collect()}
    absent = [n for n in names if found.get(n) is None]
    if absent:
        raise FileNotFoundError(f"no artifact recorded for {absent}")
    return found
