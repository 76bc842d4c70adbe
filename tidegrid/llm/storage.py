"""Tables shared by the stages of one operator: written once, read back after a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_FOLDERS: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="llm-tables-"))
    return _OWN_FOLDERS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, nothing is recomputed."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame, text: str = "text") -> F.Column:
    return F.coalesce(F.col(text), F.lit(""))


def map_texts(
    df: DataFrame,
    columns: list[F.Column],
    schema: str,
    rows: Callable[[dict[str, list]], dict[str, list | pa.Array]],
) -> DataFrame:
    """``df.select(columns)`` mapped batch by batch: ``rows`` gets and returns columns by name.

    Only the named columns cross to Python, in Arrow batches.
    """
    source = df.select(*columns)
    target = T._parse_datatype_string(schema)
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in target.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch):
                if part.num_rows:
                    made = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow
                    )

    return source.mapInArrow(run, target)


def split_batch(batch: pa.RecordBatch, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most_bytes``, so long texts don't add up in Python's memory."""
    pieces = max(1, -(-batch.nbytes // most_bytes))
    step = max(1, -(-batch.num_rows // pieces))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


@contextmanager
def batches_of(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Within, batches of rows with large values cross to Python at about so many bytes, or at the session's own limit if that is less."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    own = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    spark.conf.set(name, str(most_bytes if own <= 0 else min(own, most_bytes)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    return _ARROW[kind.simpleString()]


def keep_rows(df: DataFrame, keep: Callable[[list[str]], list[bool]], text: str = "text") -> DataFrame:
    """Rows of ``df``, with all their columns, whose text ``keep`` accepts; nulls count as empty text."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch):
                if part.num_rows:
                    yield part.filter(pa.array(keep([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def checked_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most so many (narrow) rows; joined by a shuffle beyond."""
    return F.broadcast(df) if df.count() <= rows else df
