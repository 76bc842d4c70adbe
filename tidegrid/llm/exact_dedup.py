"""Exact deduplication by composable polynomial fingerprints, verified by streaming comparison.

The normalised text is read as digits in base 256 of a polynomial, modulo a prime. The
fingerprint of a concatenation follows from those of its parts by shifting the first one by
the length of the second, ``h(ab) = h(a) * 256^|b| + h(b)``, so chunks of a huge text are
hashed independently and combined in any grouping.

Texts with equal fingerprints are then compared with the group's first text chunk by chunk.
Texts that differ from it (a collision) form groups of their own in a further round, until no
text differs. A large group is dealt out over several tasks, each with a copy of that first text.

Nulls count as empty text; all texts without a visible character are equal. A null id counts as
smallest. Rows with the same id, text and length are repeats: one of them stays.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import map_texts, split_batch, stored, text_or_empty

#: Deleted before comparison: [\x20\x09-\x0D].
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A prime whose half is (nearly) a prime too, so that powers of 256 repeat only after about 2**117 steps.
PRIME = 300289963963659643693710391004901299
CHUNK_BYTES = 4096
ROWS_A_TASK = 2_000


def normalised(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, WHITE)


@functools.lru_cache(maxsize=4096)
def _shift(length: int) -> int:
    return pow(256, length, PRIME)


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(fingerprint, length) of a concatenation."""
    return (left[0] * _shift(right[1]) + right[0]) % PRIME, left[1] + right[1]


def chunk_fingerprint(chunk: bytes) -> tuple[int, int]:
    return int.from_bytes(chunk, "big") % PRIME, len(chunk)


def fingerprint(data: bytes) -> tuple[int, int]:
    chunks = (chunk_fingerprint(data[i : i + CHUNK_BYTES]) for i in range(0, len(data), CHUNK_BYTES))
    return functools.reduce(combine, chunks, (0, 0))


def same_text(left: bytes, right: bytes) -> bool:
    """Chunkwise, up to the first difference."""
    if len(left) != len(right):
        return False
    a, b = memoryview(left), memoryview(right)
    return all(a[i : i + CHUNK_BYTES] == b[i : i + CHUNK_BYTES] for i in range(0, len(left), CHUNK_BYTES))


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, ``row_hash`` of the original text, its ``points`` (code points), ``print``, ``text_sha256``."""

    def rows(columns):
        made = {"doc_id": columns["doc_id"], "row_hash": columns["row_hash"], "points": [], "print": [], "text_sha256": []}
        for text in columns["text"]:
            data = normalised(text)
            value, length = fingerprint(data)
            made["points"].append(len(text))
            made["print"].append(f"{value:030x}{length:x}")
            made["text_sha256"].append(hashlib.sha256(data).hexdigest())
        return made

    schema = "doc_id bigint, row_hash bigint, points bigint, print string, text_sha256 string"
    return map_texts(df, _columns(df, id_column, text_column), schema, rows)


def _columns(df: DataFrame, id_column: str, text_column: str) -> list[F.Column]:
    text = text_or_empty(df, text_column)
    return [F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text")]


def _differing(texts: DataFrame) -> DataFrame:
    """Rows whose text differs from the first one of their key and lane; partitions hold whole lanes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first = None, b""
        for batch in batches:
            for part in split_batch(batch):
                found = []
                columns = (part.column(n).to_pylist() for n in ("doc_id", "row_hash", "key", "lane", "leads", "text"))
                for doc, row_hash, key, lane, leads, text in zip(*columns, strict=True):
                    if (key, lane) != current:
                        current, first = (key, lane), normalised(text)
                    elif not leads and not same_text(normalised(text), first):
                        found.append({"doc_id": doc, "row_hash": row_hash, "old_key": key})
                if found:
                    schema = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("old_key", pa.string())])
                    yield pa.RecordBatch.from_pylist(found, schema)

    return texts.mapInArrow(run, "doc_id bigint, row_hash bigint, old_key string")


def collisions(df: DataFrame, keys: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, row_hash, old_key) of ``keys`` (doc_id, row_hash, key) whose text isn't the first one of their key.

    A group is dealt out in lanes of about ``ROWS_A_TASK`` rows; each lane gets the first text too.
    """
    first = F.min(F.struct("doc_id", "row_hash")).alias("first")
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), first).where("size > 1")
    groups = groups.select("key", "first", F.ceil(F.col("size") / ROWS_A_TASK).cast("int").alias("lanes"))
    leads = F.struct("doc_id", "row_hash").eqNullSafe(F.col("first"))
    own = F.pmod(F.xxhash64("doc_id", "row_hash"), F.col("lanes")).cast("int")
    lanes = F.when(leads, F.sequence(F.lit(0), F.col("lanes") - 1)).otherwise(F.array(own))
    members = keys.join(groups, "key").select("doc_id", "row_hash", "key", leads.alias("leads"), lanes.alias("lane")).distinct()
    texts, members = df.select(_columns(df, id_column, text_column)).alias("t"), members.alias("m")
    same_row = F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.row_hash") == F.col("m.row_hash"))
    placed = texts.join(members, same_row).select("t.doc_id", "t.row_hash", "key", F.explode("lane").alias("lane"), "leads", "text")
    return _differing(placed.repartition("key", "lane").sortWithinPartitions("key", "lane", F.desc("leads")))


def exact_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the one
    with the smallest id.
    """
    rows = stored(fingerprints(df, id_column, text_column), "fingerprints").withColumnRenamed("print", "key")
    keys, rounds = rows.select("doc_id", "row_hash", "key"), 0
    while True:
        other = stored(collisions(df, keys, id_column, text_column).distinct(), "collisions")
        if other.isEmpty():
            break
        rounds += 1
        moved = other.select("doc_id", "row_hash", F.concat("old_key", F.lit(f"+{rounds}")).alias("key"))
        to, key = moved.withColumnRenamed("key", "new_key").alias("n"), F.coalesce("new_key", "key").alias("key")
        same_row = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.row_hash") == F.col("n.row_hash"))
        rows = stored(rows.alias("r").join(to, same_row, "left").select("r.*", "new_key").withColumn("key", key).drop("new_key"), "keys")
        keys = moved
    repeats = rows.groupBy("key", "doc_id", "points", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    best = F.min(F.struct((-F.col("points")).alias("less"), "doc_id")).alias("best")
    groups = repeats.groupBy("key").agg(F.sum("copies").alias("group_size"), best)
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("points") == -F.col("best.less")) & (F.col("copy") == 1)
    return (
        repeats.join(groups, "key")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")
    )
