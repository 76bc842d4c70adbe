"""Token ids in patched frame-of-reference blocks.

The format. A segment holds whole documents in order and is one row of a Parquet table::

    magic "TPF1" | n_docs u32 | n_tokens u64 | n_blocks u32
    doc ids i64 * n_docs | doc lengths u32 * n_docs | block starts u32 * n_blocks | blocks

A block holds ``BLOCK`` ids (the last one fewer)::

    minimum u32 | count u16 | width u8 | exceptions u16
    low ``width`` bits of (id - minimum), packed, least bit first, padded to a byte
    positions u16 * exceptions | high parts u32 * exceptions

The width is the least one that fits ``PERCENTILE`` per cent of a block's differences; what is
left of the others stands in the exception list. Block starts are byte offsets, so a reader
gets ids from any position by unpacking the blocks that cover it.

Segments are written by Spark: documents are range-partitioned and sorted by id; a partition is
a shard, its segments are numbered and know how many ids come before them in the shard. A
segment closes at a document border, so a document never spans two and a segment is bounded by
``SEGMENT_TOKENS`` plus one document. Only one count per shard is summed up on the driver.

Nulls count as empty text; a null id sorts first and is read back as null. Repeated rows keep
their own entries; among equal ids the order is that of the texts.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.storage import map_texts, new_path, split_batch, text_or_empty

BLOCK = 4096
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 18
END_ID = 2
NULL_ID = -(2**63)
MAGIC = b"TPF1"
_HEAD, _BLOCK_HEAD = struct.Struct("<4sIQI"), struct.Struct("<IHBH")


# Blocks.


def _cell(width: int) -> tuple[str, int]:
    """The little-endian integer that holds ``width`` bits, and its bits."""
    return ("<u2", 16) if width <= 16 else ("<u4", 32)


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    kind, cell = _cell(width)
    low = values.astype(kind)  # the cut-off high bits are exceptions
    if width == cell:
        return low.tobytes()
    bits = np.unpackbits(low.view(np.uint8), bitorder="little").reshape(-1, cell)[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def _unpack_bits(packed: np.ndarray, count: int, width: int) -> np.ndarray:
    kind, cell = _cell(width)
    if width == cell:
        return packed.view(kind)
    wide = np.zeros((count, cell), np.uint8)
    wide[:, :width] = np.unpackbits(packed, count=count * width, bitorder="little").reshape(count, width)
    return np.packbits(wide, bitorder="little").view(kind)


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    chosen = int(np.partition(rest, (k := max(0, -(-len(rest) * PERCENTILE // 100) - 1)))[k])
    width = chosen.bit_length()
    high = (rest.astype(np.uint64) >> np.uint64(width)).astype(np.uint32)
    outliers = np.flatnonzero(high)
    packed = _pack_bits(rest, width)
    tail = outliers.astype("<u2").tobytes() + high[outliers].astype("<u4").tobytes()
    return _BLOCK_HEAD.pack(low, len(ids), width, len(outliers)) + packed + tail


def unpack_block(data: memoryview) -> np.ndarray:
    low, count, width, exceptions = _BLOCK_HEAD.unpack_from(data)
    at = _BLOCK_HEAD.size
    size = -(-count * width // 8)
    ids = _unpack_bits(np.frombuffer(data, np.uint8, size, at), count, width).astype(np.uint64)
    positions = np.frombuffer(data, "<u2", exceptions, at + size)
    high = np.frombuffer(data, "<u4", exceptions, at + size + 2 * exceptions)
    ids[positions] |= high.astype(np.uint64) << np.uint64(width)
    return (ids + np.uint64(low)).astype(np.uint32)


# Segments.


def pack_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = [0, *accumulate(map(len, blocks))][:-1] if blocks else []
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(blocks))
    index = np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + np.array(starts, "<u4").tobytes()
    return b"".join([head, index, *blocks])


class Segment:
    """A segment's indexes; ids are unpacked on demand."""

    def __init__(self, data: bytes):
        magic, docs, self.n_tokens, blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        self.block_starts = np.frombuffer(data, "<u4", blocks, at + 12 * docs)
        self._blocks = memoryview(data)[at + 12 * docs + 4 * blocks :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_tokens if stop is None else min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        parts = [unpack_block(self._blocks[int(b) :]) for b in self.block_starts[first : (stop - 1) // BLOCK + 1]]
        return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]


# Ids of texts.

#: White space of the vocabulary's splitting; borders of these pieces are borders of its words.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?%&*#$|\"()-"
#: Letters followed by marks up to the end of a piece are two words, whatever stands around them.
_PIECES = re.compile(
    f" ?[{_LETTERS}]++(?=[{_MARKS}]*+(?:[{_SPACE}]|\\Z))|(?<=[{_LETTERS}])[{_MARKS}]++(?=[{_SPACE}]|\\Z)"
    f"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_KEPT, _KEPT_CHARS = 600_000, 48


class TextEncoder:
    """The tokenizers library with a memory for words: a text's new words are encoded in one call.

    New words are joined by line breaks, which no word contains, so the breaks' id separates
    their ids. Needs a byte-level vocabulary that splits at white space and has no normaliser. A
    text with the string of an added token is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        (self._break,) = self._whole("\n").tolist()
        self._known: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learnt(self, pieces: set[str]) -> list[str]:
        """Add the ids of new pieces; what was added, in the order of the ids."""
        solid = [piece for piece in pieces if not piece.isspace()]
        if solid:
            ids = self._whole("\n".join(solid))
            ends = (4 * np.flatnonzero(ids == self._break)).tolist()
            raw = ids.tobytes()
            ends.append(len(raw))
            starts = [0, *(end + 4 for end in ends[:-1])]
            self._known.update(zip(solid, [raw[start:end] for start, end in zip(starts, ends, strict=True)], strict=True))
        if len(solid) == len(pieces):
            return solid
        blank = [piece for piece in pieces if piece.isspace()]
        self._known.update((piece, self._whole(piece).tobytes()) for piece in blank)
        return blank + solid

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if any(a in text for a in self._added):
            return self._whole(text).tobytes()
        pieces, known = _PIECES.findall(text), self._known
        new = set(pieces).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, pieces))
        room = max(0, _KEPT - len(known))
        added = self._learnt(new)
        joined = b"".join(map(known.__getitem__, pieces))
        for piece in added[room:]:
            del known[piece]
        for piece in [piece for piece in added[:room] if len(piece) > _KEPT_CHARS]:
            del known[piece]
        return joined


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


# Files.

_WRITTEN = "shard int, segment int, shard_start bigint, n_docs bigint, n_tokens bigint, data binary"


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode, append ``end_id`` to each document, and write segments in ascending order of id to ``path``."""
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = text_encoder(tokenizer_path), TaskContext.get().partitionId()
        number, before, docs, lengths, parts, held = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            data = pack_segment(docs, lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (shard, number, before, len(docs), held, data), strict=True))], schema)

        for batch in batches:
            for part in split_batch(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text) + end
                    docs.append(NULL_ID if doc is None else doc)
                    lengths.append(len(ids) // 4)
                    parts.append(ids)
                    held += len(ids) // 4
                    if held >= SEGMENT_TOKENS:
                        yield closed()
                        number, before, docs, lengths, parts, held = number + 1, before + held, [], [], [], 0
        if docs:
            yield closed()

    texts = df.select(F.col(id_column).cast("bigint").alias("doc_id"), text_or_empty(df, text_column).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _WRITTEN).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, ``start`` (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(_WRITTEN).parquet(path)
    shards = sorted((r.shard, r.n) for r in segments.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases = dict(zip((s for s, _ in shards), accumulate((n for _, n in shards), initial=0), strict=False))

    def rows(columns):
        made = {n: [] for n in ("doc_id", "start", "n_tokens", "ids_crc32")}
        for shard, shard_start, data in zip(columns["shard"], columns["shard_start"], columns["data"], strict=True):
            segment = Segment(data)
            raw, at = memoryview(segment.ids().astype("<u4").tobytes()), 0
            for doc, n in zip(segment.doc_ids.tolist(), segment.lengths.tolist(), strict=True):
                made["doc_id"].append(None if doc == NULL_ID else doc)
                made["start"].append(bases[shard] + shard_start + at)
                made["n_tokens"].append(n)
                made["ids_crc32"].append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                at += n
        return made

    return map_texts(segments, [F.col("shard"), F.col("shard_start"), F.col("data")], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", rows)


def tokens_on_file(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the documents' ids to the shared folder and read them back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "tokens")
    write_tokens(df, path, tokenizer_path, **options)
    return read_tokens(spark, path)
