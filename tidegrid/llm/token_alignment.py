"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Incidence matrices are in CSR form, built by hand from token lengths: A has a row per token of
the first tokenizer and a column per byte, B likewise. The row products of Gustavson (1978)
give A x B-transposed, whose entries are the overlaps of two tokens in bytes. Bytes where
tokens of both end cut them into groups; the product of the two token-group incidences links
all tokens of a group.

A text is cut where neither tokenizer can join two sides, so equal pieces align equally and a
task aligns each piece once. Cuts are before a space or line break that follows a character
other than white space, and around a lone line break. The byte-level vocabulary never joins
such characters by its splitting rule; the piece vocabulary has no piece with a space after
another character, or with a line break (checked when it is loaded).

How often two ids are linked is counted over the whole corpus. Pairs of ids with at least one
in ``HEAVY`` of all links are fewer than ``HEAVY``, so they go to all tasks as one bounded
array; links of all other pairs are joined by a shuffle, in which no pair has more than that
share. Links of a document stay in its row as distinct pairs with their numbers.

Null and empty texts, and texts that either tokenizer does not give back byte by byte, have no
tokens: zeros and an empty digest. Repeated rows and null ids keep their own rows and count each
time. An empty table gives no rows. The table's further columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import split_batch, stored, text_or_empty

HEAVY = 1 << 19
KEPT_PIECES, KEPT_CHARS = 300_000, 64
BATCH_BYTES = 4 << 20
EXPANSION = 1 << 22
COUNTED = 1 << 21
#: Codes of pairs are ``a << SHIFT | b``.
SHIFT = 24
SPACE_MARK = "\u2581"

#: White space of the byte-level vocabulary's splitting.
_W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(
    rf" ?[^{_W}]++(?=[ \n]|\Z)|\n(?=[^{_W}]| [^{_W}]|\Z)|(?s:.+?)(?:(?<=[^{_W}])(?=[ \n])|\Z)"
)


# Sparse incidence.


@dataclass
class Csr:
    """A 0/1 matrix by rows: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        counts = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate([[0], np.cumsum(counts)]), rows[order], len(self.starts) - 1)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Incidence of tokens that follow each other, and bytes."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(starts, np.arange(starts[-1]), int(starts[-1]))


def token_groups(ends: np.ndarray, common: np.ndarray) -> Csr:
    """Incidence of tokens, by their end, and the groups that common ends cut."""
    return Csr(np.arange(len(ends) + 1), np.searchsorted(common, ends), len(common))


def row_products(a: Csr, b: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of two matrices row by row: rows, columns and values of its entries, in order.

    Row i of the product is the sum of the rows of b that row i of a names. Rows are taken in
    blocks that name at most about ``EXPANSION`` entries.
    """
    named = np.diff(b.starts)[a.columns]
    upto = np.concatenate([[0], np.cumsum(named)])
    made = upto[a.starts]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    first, n = 0, len(a.starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(made, made[first] + EXPANSION, side="right")) - 1)
        entries = slice(a.starts[first], a.starts[last])
        counts = named[entries]
        offset = np.arange(counts.sum()) - np.repeat(upto[entries] - upto[entries.start], counts)
        columns = b.columns[np.repeat(b.starts[a.columns[entries]], counts) + offset]
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(a.starts[first : last + 1])), counts)
        cells, values = np.unique(rows * b.width + columns, return_counts=True)
        found.append((cells // b.width, cells % b.width, values))
        first = last
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


@dataclass
class Alignment:
    """Links of two token sequences over the same bytes; tokens are numbered from 0."""

    link_a: np.ndarray
    link_b: np.ndarray
    overlap: np.ndarray
    ends: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray

    def shared_group_links(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens within a group."""
        groups = len(self.ends)
        a = Csr(np.arange(len(self.group_a) + 1), self.group_a, groups)
        b = Csr(np.arange(len(self.group_b) + 1), self.group_b, groups)
        return row_products(a, b.transposed())[:2]


def align(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Alignment:
    """Overlap links and groups of two sequences of token lengths in bytes with one sum."""
    a, b = token_bytes(lengths_a), token_bytes(lengths_b)
    rows, columns, values = row_products(a, b.transposed())
    common = np.intersect1d(a.starts[1:], b.starts[1:], assume_unique=True)
    group_a, group_b = (token_groups(m.starts[1:], common).columns for m in (a, b))
    return Alignment(rows, columns, values, common, group_a, group_b)


# Pieces.


def _byte_of_symbol() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Aligns batches of texts, with a memory for pieces.

    Needs a byte-level vocabulary that splits words from white space and has no normaliser, and
    a piece vocabulary with a prefix space and byte pieces.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        symbol = _byte_of_symbol()
        size = self._a.get_vocab_size()
        self.a_bytes = [bytes(symbol[c] for c in self._a.id_to_token(i)) if set(self._a.id_to_token(i)) <= symbol.keys() else b"" for i in range(size)]
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        if any("\n" in p or SPACE_MARK in p.lstrip(SPACE_MARK) for p in names):
            raise ValueError("a piece joins words, so texts can't be cut between them")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)
        ]
        self._a_lengths = np.array([len(t) for t in self.a_bytes], np.int64)
        self._b_lengths = np.array([len(t) for t in self.b_bytes], np.int64)
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._digests: list[str] = []
        self._measures = np.zeros((0, 5), np.int64)  # tokens a, tokens b, groups, links, shared-group links
        self._bad = np.zeros(0, bool)
        self._starts, self._codes = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def ids(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of pieces of ``" " + text``."""
        a = [e.ids for e in self._a.encode_batch_fast(pieces, add_special_tokens=False)]
        # The prefix space stands for a piece's own; other pieces follow a line break, which is cut off again.
        b = self._b.encode([p[1:] if p[0] == " " and len(p) > 1 else "\n" + p for p in pieces], num_threads=1)
        return a, [i if p[0] == " " and len(p) > 1 else i[2:] for p, i in zip(pieces, b)]

    def _learn(self, pieces: list[str]) -> None:
        """Align new pieces at once: one behind the other, each ends a group of its own."""
        ids_a, ids_b = self.ids(pieces)
        bad = np.zeros(len(pieces), bool)
        for k, (piece, a, b) in enumerate(zip(pieces, ids_a, ids_b)):
            text = piece.encode()
            if b"".join([self.a_bytes[i] for i in a]) != text or b"".join([self.b_bytes[i] for i in b]) != text:
                bad[k], ids_a[k], ids_b[k] = True, [], []
        n_a, n_b = (np.array([len(i) for i in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for ids in some for i in ids], np.int64) for some in (ids_a, ids_b))
        made = align(self._a_lengths[a], self._b_lengths[b])
        shared = made.shared_group_links()[0]
        piece_a, piece_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
        group_piece = np.zeros(len(made.ends), np.int64)
        group_piece[made.group_a] = piece_a
        count = lambda of: np.bincount(of, minlength=len(pieces))
        links = count(piece_a[made.link_a])
        measures = np.stack([n_a, n_b, count(group_piece), links, count(piece_a[shared])], axis=1)
        first_a, first_b = (np.searchsorted(g, np.arange(len(made.ends) + 1)).tolist() for g in (made.group_a, made.group_b))
        names_a, names_b = [str(i) for i in a.tolist()], [str(i) for i in b.tolist()]
        groups = [
            ",".join(names_a[i:j]) + "|" + ",".join(names_b[k:m])
            for i, j, k, m in zip(first_a, first_a[1:], first_b, first_b[1:])
        ]
        at = 0
        for k, (piece, n) in enumerate(zip(pieces, measures[:, 2].tolist())):
            self._number[piece] = len(self._digests)
            self._digests.append(";".join(groups[at : at + n]))
            at += n
        self._measures = np.concatenate([self._measures, measures])
        self._bad = np.concatenate([self._bad, bad])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(links)])
        self._codes = np.concatenate([self._codes, a[made.link_a] << SHIFT | b[made.link_b]])

    def documents(self, texts: list[str]) -> dict[str, list]:
        """Measures, digest and distinct pairs of every text."""
        cut = [[] if not t or SPACE_MARK in t else _PIECES.findall(" " + t) for t in texts]
        new = list({p for pieces in cut for p in pieces if p not in self._number})
        for k in range(0, len(new), 50_000):
            self._learn(new[k : k + 50_000])
        number = self._number
        numbers = [[number[p] for p in pieces] for pieces in cut]
        flat = np.array([i for some in numbers for i in some], np.int64)
        ends = np.cumsum([len(some) for some in numbers])
        upto = lambda values: np.concatenate([[0], np.cumsum(values)])
        starts = np.concatenate([[0], ends[:-1]])
        bad = upto(self._bad[flat])
        good = (bad[ends] == bad[starts]) & (ends > starts)
        sums = {}
        for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links", "n_group_links")):
            total = upto(self._measures[flat, k])
            sums[name] = np.where(good, total[ends] - total[starts], 0)
        text = self._digests
        digests = [
            hashlib.sha256(";".join([text[i] for i in some]).encode()).hexdigest() if ok else "" for some, ok in zip(numbers, good.tolist())
        ]
        codes, times = self._pairs(flat, ends, good)
        if len(self._number) > KEPT_PIECES or len(self._codes) > 24 * KEPT_PIECES:
            self._forget()
        return sums | {"groups_sha256": digests, "codes": codes, "times": times}

    def _pairs(self, flat: np.ndarray, ends: np.ndarray, good: np.ndarray) -> tuple[pa.Array, pa.Array]:
        document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        flat, document = flat[good[document]], document[good[document]]
        cells, repeats = np.unique(document << 32 | flat, return_counts=True)
        document, flat = cells >> 32, cells & 0xFFFFFFFF
        counts = self._starts[flat + 1] - self._starts[flat]
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        code = self._codes[np.repeat(self._starts[flat], counts) + offset]
        document, repeats = np.repeat(document, counts), np.repeat(repeats, counts)
        order = np.lexsort((code, document))
        document, code, repeats = document[order], code[order], repeats[order]
        first = np.flatnonzero(np.diff(code, prepend=-1) | np.diff(document, prepend=-1))
        times = np.add.reduceat(repeats, first) if len(first) else repeats
        borders = pa.array(np.searchsorted(document[first], np.arange(len(ends) + 1)), pa.int32())
        lists = lambda values, kind: pa.ListArray.from_arrays(borders, pa.array(values, kind))
        return lists(code[first], pa.int64()), lists(times, pa.int64())

    def links(self, text: str) -> dict[str, list[int]]:
        """Ids, links with their overlap in bytes, and groups of one text."""
        pieces = _PIECES.findall(" " + text) if text and SPACE_MARK not in text else []
        ids_a, ids_b = self.ids(pieces) if pieces else ([], [])
        a, b = ([i for some in ids for i in some] for ids in (ids_a, ids_b))
        whole = (" " + text).encode()
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            a, b = [], []
        made = align(self._a_lengths[np.array(a, np.int64)], self._b_lengths[np.array(b, np.int64)])
        parts = {"link_a": made.link_a, "link_b": made.link_b, "overlap": made.overlap, "group_a": made.group_a, "group_b": made.group_b}
        return {"a_ids": a, "b_ids": b} | {name: part.tolist() for name, part in parts.items()}


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


# Tables.

_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
_LINKS = ("a_ids", "b_ids", "link_a", "link_b", "overlap", "group_a", "group_b")


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row: doc_id, both tokenizers' ids, links by token number with their bytes, and each token's group."""
    schema = pa.schema([("doc_id", pa.int64()), *((name, pa.list_(pa.int64())) for name in _LINKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, BATCH_BYTES // 4):
                made = [aligner(a_path, b_path).links(t) for t in part.column(1).to_pylist()]
                columns = [pa.array([m[name] for m in made], pa.list_(pa.int64())) for name in _LINKS]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} array<bigint>" for c in _LINKS))


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    lists = pa.list_(pa.int64())
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in _MEASURES), ("groups_sha256", pa.string()), ("codes", lists), ("times", lists)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, BATCH_BYTES):
                if part.num_rows:
                    made = aligner(a_path, b_path).documents(part.column(1).to_pylist())
                    columns = [v if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in list(schema)[1:]]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=schema)

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty(docs).alias("text")]
    ddl = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _MEASURES) + ", groups_sha256 string, codes array<bigint>, times array<bigint>"
    return docs.select(*columns).mapInArrow(run, ddl)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``code, n, best`` of every pair of ids; best: no pair of the same b has more links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in split_batch(batch):
                waiting.append(tuple(part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)))
                size += len(waiting[-1][0])
                if size > COUNTED:
                    waiting = [_summed(waiting)]
                    size = len(waiting[0][0])
                    if size > COUNTED // 2:
                        yield _counted(*waiting[0])
                        waiting, size = [], 0
        if waiting:
            yield _counted(*_summed(waiting))

    partial = aligned.select("codes", "times").mapInArrow(run, "code bigint, n bigint")
    counts = stored(partial.groupBy("code").agg(F.sum("n").alias("n")), "align-pairs")
    b = F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, times = (np.concatenate(some) for some in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, times = code[order], times[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(times, first) if len(first) else times


def _counted(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


def alignment(docs: DataFrame, a_path: str, b_path: str, *, heavy: int = HEAVY) -> DataFrame:
    """Per row: doc_id, numbers of tokens, groups and links, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``n_group_links`` counts the pairs of tokens that share a group.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id().alias("_row")
    aligned = stored(_aligned(docs, a_path, b_path).select("*", row), "align-documents")
    pairs = stored(pair_counts(aligned), "align-counts")
    number, links = pairs.agg(F.count("code"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = 1 if number <= heavy else links // heavy + 1
    known = pairs.where(F.col("n") >= least).orderBy("code").toArrow()
    shared = spark.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("code", "n", "best")))

    names = ["_row", "doc_id", *_MEASURES, "groups_sha256"]
    schema = pa.schema(
        [(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in (*names, "n_best", "count_sum")]
        + [("codes", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for batch in batches:
            for part in split_batch(batch):
                lists = part.column(len(names))
                sizes = lists.value_lengths().to_numpy()
                codes, times = (part.column(len(names) + k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
                at = np.minimum(np.searchsorted(code, codes), max(0, len(code) - 1))
                hit = code[at] == codes if len(code) else np.zeros(len(codes), bool)
                place = at[hit]
                rows = np.repeat(np.arange(len(sizes)), sizes)
                sums = []
                for values in (best, count):
                    total = np.zeros(len(sizes), np.int64)
                    np.add.at(total, rows[hit], times[hit] * values[place])
                    sums.append(pa.array(total))
                borders = pa.array(np.searchsorted(rows[~hit], np.arange(len(sizes) + 1)), pa.int32())
                rest = [pa.ListArray.from_arrays(borders, pa.array(v[~hit], pa.int64())) for v in (codes, times)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *sums, *rest], schema=schema)

    ddl = ", ".join(f"{f.name} {'string' if f.name == 'groups_sha256' else 'array<bigint>' if pa.types.is_list(f.type) else 'bigint'}" for f in schema)
    scored = aligned.select(*names, "codes", "times").mapInArrow(score, ddl)
    result = ["doc_id", *_MEASURES, "n_best", "count_sum", "groups_sha256"]
    if least == 1:
        return scored.select(*result)  # every pair is known to all tasks: no link is left
    scored = stored(scored, "align-scored")
    light = scored.select("_row", F.posexplode("codes").alias("_at", "code"), "times").select(
        "_row", "code", F.get("times", F.col("_at")).alias("times")
    )
    more = light.join(pairs.where(F.col("n") < least), "code").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("best")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    whole = scored.join(more, "_row", "left").withColumns(
        {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    )
    return whole.select(*result)
