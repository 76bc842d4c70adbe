"""Source divergence audit: how the word use of each source differs from its language and its peers.

Term counts come from single-pass in-memory indexing. A task keeps the postings (term to counts
per source, and documents that hold the term) of a block of documents in memory; when they
reach ``MEMORY`` bytes they leave as a run, cut by hash shard, sorted by term. A shard's task
merges its runs with a heap: rows of a run hold up to ``BLOCK_TERMS`` terms and arrive by their
first term, so a row is opened only when the merge reaches that term, and a run has one open
row at a time. With more than ``FAN_IN`` runs, groups of runs are merged to longer runs first.

The divergence of two sources is a sum over all kept terms of the language, though most terms
are absent from most sources. An absent term has the same share in all such cases, so the sum
starts as terms times the difference of the two shares of an absent term, and every block of
merged terms streams corrections for the terms that one of the two has. Corrections are summed
per task, one vector per source, before they are shuffled.

All arithmetic is on integers: shares are whole parts of ``SCALE``, divided digit by digit, so
counts of 10**15 don't overflow. Null texts, languages and sources count as ''. A text is read
as a whole. Repeated rows count each time. A language without kept terms has pairs of value 0.
An empty table gives no rows. Further columns of the table play no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.storage import split_batch, stored

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
MEMORY = 96 << 20
BLOCK_TERMS = 512
FAN_IN = 2000
SHARDS_A_PARTITION = 2
VECTOR_CELLS = 1 << 21

#: Bytes outside of terms become spaces and A-Z lower case; every byte of other characters is part of a term.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Estimated bytes of a posting besides its term.
_TERM_COST, _POSTING_COST = 480, 60

_RUNS = (
    "run bigint, shard int, lang binary, head binary, terms array<binary>, docs array<bigint>,"
    " width array<int>, source array<int>, occurrences array<bigint>, names array<binary>"
)
_RUNS_ARROW = pa.schema(
    [
        ("run", pa.int64()), ("shard", pa.int32()), ("lang", pa.binary()), ("head", pa.binary()),
        ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())), ("width", pa.list_(pa.int32())),
        ("source", pa.list_(pa.int32())), ("occurrences", pa.list_(pa.int64())), ("names", pa.list_(pa.binary())),
    ]
)


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_TERM_BYTES).split()


# Runs.


class _Block:
    """Postings of the documents read since the last run."""

    def __init__(self) -> None:
        self.terms: dict[bytes, dict[bytes, list]] = {}  # lang, term: [documents, {source: occurrences}]
        self.sources: dict[bytes, set[bytes]] = {}
        self.bytes = 0

    def add(self, lang: bytes, source: bytes, text: bytes) -> None:
        self.sources.setdefault(lang, set()).add(source)
        index = self.terms.setdefault(lang, {})
        for term, times in Counter(terms_of(text)).items():
            posting = index.get(term)
            if posting is None:
                index[term] = [1, {source: times}]
                self.bytes += _TERM_COST + len(term)
                continue
            posting[0] += 1
            counts = posting[1]
            if source in counts:
                counts[source] += times
            else:
                counts[source] = times
                self.bytes += _POSTING_COST

    def run(self, number: int, shards: int) -> Iterator[tuple]:
        """The block's rows: one without terms per language, for its sources, then terms by shard in order."""
        for lang, index in self.terms.items():
            yield number, 0, lang, [], [], sorted(self.sources[lang])
            by_shard: dict[int, list[bytes]] = {}
            salt = zlib.crc32(lang)
            for term in index:
                by_shard.setdefault(zlib.crc32(term, salt) % shards, []).append(term)
            for shard, terms in by_shard.items():
                writer = _Writer(number, shard, lang)
                for term in sorted(terms):
                    yield from writer.add(term, *index[term])
                yield from writer.close()


class _Writer:
    """Sorted terms of one shard and language, cut to rows; sources are numbered per row."""

    def __init__(self, run: int, shard: int, lang: bytes) -> None:
        self.group = run, shard, lang
        self._clear()

    def _clear(self) -> None:
        self.terms: list[bytes] = []
        self.postings: list[tuple[int, list[int], list[int]]] = []
        self.names: dict[bytes, int] = {}
        self.cells = 0

    def add(self, term: bytes, docs: int, counts: dict[bytes, int]) -> Iterator[tuple]:
        numbers = [self.names.setdefault(s, len(self.names)) for s in counts]
        self.terms.append(term)
        self.postings.append((docs, numbers, list(counts.values())))
        self.cells += len(numbers) + len(term) // 8
        if len(self.terms) >= BLOCK_TERMS or self.cells >= 16 * BLOCK_TERMS:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.terms:
            yield *self.group, self.terms, self.postings, list(self.names)
            self._clear()


def _packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of a few thousand terms."""
    waiting: list[tuple] = []
    terms = 0
    for row in rows:
        waiting.append(row)
        terms += 16 + len(row[3])
        if terms >= 16 * BLOCK_TERMS:
            yield _batch(waiting)
            waiting, terms = [], 0
    if waiting:
        yield _batch(waiting)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    runs, shards, langs, terms, postings, names = zip(*rows)
    columns = [
        runs, shards, langs, [t[0] if t else b"" for t in terms], terms,
        [[p[0] for p in b] for b in postings], [[len(p[1]) for p in b] for b in postings],
        [[s for p in b for s in p[1]] for b in postings], [[c for p in b for c in p[2]] for b in postings], names,
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS_ARROW)], schema=_RUNS_ARROW)


def build_runs(docs: DataFrame, shards: int, memory: int = MEMORY) -> DataFrame:
    """One pass over the documents: term-sorted runs, one or more a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block, number = _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in split_batch(batch):
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    block.add(lang, source, text)
                    if block.bytes >= memory:
                        yield from block.run(number, shards)
                        block, number = _Block(), number + 1
        yield from block.run(number, shards)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")]
    return docs.select(*columns).mapInArrow(lambda batches: _packed(rows(batches)), _RUNS)


# Merge.


def _entries(row: dict) -> Iterator[tuple[bytes, int, dict, int, int]]:
    """Term, documents, and where in the row its postings lie."""
    at = 0
    for term, docs, width in zip(row["terms"], row["docs"], row["width"]):
        yield term, docs, row, at, at + width
        at += width


def merged_terms(rows: Iterator[dict], least_documents: int = 1) -> Iterator[tuple[tuple, bytes, int, dict[bytes, int]]]:
    """Heap merge of rows that come sorted by group, language and first term; one result per term.

    A row is opened when the merge reaches its first term, so at most one row of each run is open.
    """
    heap: list[tuple[bytes, int, tuple, Iterator]] = []
    opened, group, coming = 0, None, next(rows, None)
    while heap or coming is not None:
        if not heap:
            group = (coming["run"], coming["shard"], coming["lang"])
        while coming is not None and (coming["run"], coming["shard"], coming["lang"]) == group and (not heap or coming["head"] <= heap[0][0]):
            entries = _entries(coming)
            first = next(entries, None)
            if first is not None:
                opened += 1
                heapq.heappush(heap, (first[0], opened, first, entries))
            coming = next(rows, None)
        if not heap:
            continue
        term, docs, found = heap[0][0], 0, []
        while heap and heap[0][0] == term:
            _, number, entry, entries = heap[0]
            docs += entry[1]
            found.append(entry)
            following = next(entries, None)
            if following is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (following[0], number, following, entries))
        if docs < least_documents:
            continue
        total: dict[bytes, int] = {}
        for _, _, row, start, end in found:
            for source, times in zip(row["source"][start:end], row["occurrences"][start:end]):
                name = row["names"][source]
                total[name] = total.get(name, 0) + times
        yield group, term, docs, total


def merge_runs(runs: DataFrame, least_documents: int = 1) -> DataFrame:
    """Rows with an equal ``run`` and ``shard`` merged; terms in fewer documents of the language left out."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        rows = (row for batch in batches for part in split_batch(batch, 4 << 20) for row in part.to_pylist())
        writer = None
        for group, term, docs, counts in merged_terms(rows, least_documents):
            if writer is None or writer.group != group:
                if writer is not None:
                    yield from writer.close()
                writer = _Writer(*group)
            yield from writer.add(term, docs, counts)
        if writer is not None:
            yield from writer.close()

    dealt = runs.repartition("run", "shard").sortWithinPartitions("run", "shard", "lang", "head")
    return dealt.mapInArrow(lambda batches: _packed(merge(batches)), _RUNS)


def kept_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, memory: int = MEMORY, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """Blocks of kept terms with their counts per source, and the runs (whose rows without terms name all sources)."""
    shards = SHARDS_A_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = runs = stored(build_runs(docs, shards, memory), "audit-runs")
    terms = F.size("terms") > 0
    while (count := runs.where(terms).select("run").distinct().count()) > fan_in:
        groups = -(-count // fan_in)
        runs = stored(merge_runs(runs.where(terms).withColumn("run", F.pmod(F.hash("run"), F.lit(groups)).cast("bigint"))), "audit-merge")
    whole = runs.where(terms).withColumn("run", F.lit(0).cast("bigint"))
    return stored(merge_runs(whole, least_documents), "audit-terms"), first


# Shares and divergences.


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * counts / totals)`` for counts up to totals, in steps of three digits."""
    quotient, rest = np.divmod(counts, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        quotient = quotient * 1000 + digit
    return quotient + 1


_PARTS = "lang binary, part string, source binary, item binary, value bigint, deltas array<bigint>"
_PARTS_ARROW = pa.schema(
    [("lang", pa.binary()), ("part", pa.string()), ("source", pa.binary()), ("item", pa.binary()), ("value", pa.int64()), ("deltas", pa.list_(pa.int64()))]
)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PARTS_ARROW)], schema=_PARTS_ARROW)


def _corrections(blocks: DataFrame, top: int) -> DataFrame:
    """From blocks joined to their language's sources: corrections of pairs and each block's leading terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas: dict[tuple[bytes, int], np.ndarray] = {}
        peers: dict[bytes, list[bytes]] = {}
        cells = 0
        for batch in batches:
            for part in split_batch(batch, 4 << 20):
                for row in part.to_pylist():
                    lang, peers[row["lang"]] = row["lang"], row["peers"]
                    totals = np.array(row["totals"], np.int64)
                    absent = shares(np.full(len(totals), SMOOTHING, np.int64), totals)
                    place = {s: i for i, s in enumerate(row["peers"])}
                    own = np.array([place[s] for s in row["names"]], np.int64)
                    line = np.repeat(np.arange(len(row["terms"])), row["width"])
                    column, count = own[np.array(row["source"], np.int64)], np.array(row["occurrences"], np.int64)
                    whole = np.zeros(len(row["terms"]), np.int64)
                    np.add.at(whole, line, count)
                    usual = shares(whole + SMOOTHING, np.full(len(whole), row["total"], np.int64))
                    share = shares(count + SMOOTHING, totals[column])
                    order = np.argsort(column, kind="stable")
                    leading: list[tuple] = []
                    for members in np.split(order, np.flatnonzero(np.diff(column[order])) + 1):
                        g = int(column[members[0]])
                        delta = _against_all(g, members, line, column, share, absent)
                        if (lang, g) in deltas:
                            deltas[lang, g] += delta
                        else:
                            deltas[lang, g] = delta
                            cells += len(delta)
                        more = share[members] - usual[line[members]]
                        lead = members[more > 0]
                        more = more[more > 0]
                        best = sorted(zip((-more).tolist(), (row["terms"][k] for k in line[lead].tolist())))[:top]
                        leading += [(lang, "term", row["peers"][g], t, -v, None) for v, t in best]
                    if leading:
                        yield _parts(leading)
                    if cells > VECTOR_CELLS:
                        yield from _flush(deltas, peers)
                        deltas, cells = {}, 0
        yield from _flush(deltas, peers)

    return blocks.mapInArrow(run, _PARTS)


def _against_all(g: int, members: np.ndarray, line: np.ndarray, column: np.ndarray, share: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Corrections of source ``g`` against each other one over the terms that ``g`` has.

    A term that both have is counted by the one with the smaller number.
    """
    own = np.zeros(int(line.max()) + 1, np.int64)
    own[line[members]] = share[members]
    base = np.abs(absent - absent[g])
    mine = share[members]
    # Against sources without the term: |own - absent| depends on the peer only through its absent share.
    delta = np.zeros(len(absent), np.int64)
    for h in range(0, len(absent), 256):
        peer = absent[h : h + 256]
        for k in range(0, len(mine), 4096):
            delta[h : h + 256] += np.abs(mine[k : k + 4096, None] - peer[None, :]).sum(axis=0)
    delta -= len(mine) * base
    # Where the peer has the term too, put its own share in place of the absent one, or leave the term to it.
    both = np.flatnonzero(own[line] > 0)
    both = both[column[both] != g]
    h, p = column[both], own[line[both]]
    instead = np.where(h > g, np.abs(p - share[both]) - base[h], 0) - (np.abs(p - absent[h]) - base[h])
    np.add.at(delta, h, instead)
    delta[g] = 0
    return delta


def _flush(deltas: dict, peers: dict) -> Iterator[pa.RecordBatch]:
    for (lang, g), delta in deltas.items():
        yield _parts([(lang, "pair", peers[lang][g], None, None, delta.tolist())])


def divergence(
    docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, memory: int = MEMORY, fan_in: int = FAN_IN
) -> DataFrame:
    """``lang, source, part, item, value, rank``: every peer of a source, and the terms it favours most."""
    blocks, runs = kept_terms(docs, least_documents, memory, fan_in)
    counted = blocks.select("lang", F.posexplode("source").alias("at", "number"), "names", "occurrences").select(
        "lang", F.get("names", F.col("number")).alias("source"), F.get("occurrences", F.col("at")).alias("n")
    )
    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = runs.where(F.size("terms") == 0).select("lang", F.explode("names").alias("source")).distinct()
    sized = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    listed = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("_sources")
    )
    smooth = SMOOTHING * F.col("kept")
    langs = listed.join(sized, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))).select(
        "lang", "kept", F.col("_sources.source").alias("peers"),
        F.transform("_sources.n", lambda n: n + smooth).alias("totals"),
        (F.aggregate("_sources.n", F.lit(0).cast("bigint"), lambda a, n: a + n) + smooth).alias("total"),
    )
    langs = stored(langs, "audit-sources")
    parts = stored(_corrections(blocks.drop("run", "shard", "head", "docs").join(langs.drop("kept"), "lang"), top_terms), "audit-parts")

    absent = F.transform("totals", lambda n: 1 + F.call_function("div", F.lit(SMOOTHING * SCALE).cast("bigint"), n))
    based = langs.withColumn("_absent", F.when(F.col("kept") > 0, absent))
    pairs = based.select("lang", "kept", "peers", "_absent", F.posexplode("peers").alias("_g", "source")).select(
        "lang", "kept", "_g", "source", "_absent", F.posexplode("peers").alias("_h", "item")
    ).where("_g != _h")
    apart = F.abs(F.get("_absent", F.col("_g")) - F.get("_absent", F.col("_h")))
    start = pairs.select("lang", "source", "item", F.coalesce(F.col("kept") * apart, F.lit(0)).alias("value"))
    moved = parts.where("part = 'pair'").join(langs.select("lang", "peers"), "lang").select(
        "lang", "source", "peers", F.posexplode("deltas").alias("_h", "value")
    ).select("lang", "source", F.get("peers", F.col("_h")).alias("item"), "value").where("source != item")
    back = moved.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pair = start.unionByName(moved).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    term = parts.where("part = 'term'").select("lang", "source", "item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pair.withColumns({"part": F.lit("pair"), "rank": place}).unionByName(
        term.withColumns({"part": F.lit("term"), "rank": place}).where(F.col("rank") <= top_terms)
    )
    text = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return ranked.select(*text, "part", F.col("item").cast("string").alias("item"), "value", "rank")
