"""N-gram Jaccard join by MinHash banding.

1. Each text becomes the set of hashes of its word n-grams. Texts with equal sets form a class;
   its representative is the row with the smallest id. Copies are not expanded any further.
2. A class has a MinHash signature of bands x rows minima. The number of bands is the least one
   that finds a pair at the threshold with the target recall. Classes that share a band hash
   are candidates; each is linked to the smallest class of its bucket only (a star), and the
   components of those links are the candidate groups. All candidates of a class are in its
   group.
3. The sets of a group meet once. A large group is cut into blocks of bounded size, and each
   pair of blocks is a task of its own, so no task holds more than two blocks. There, pairs
   that share a band are verified on their full sets. What leaves a task is the number of links
   per class, and a spanning forest of the links, never the pairs.
4. The components of the forests are the near-duplicate groups.

Words are runs of letters and digits, lower-cased. A text of fewer words than ``n`` has one
n-gram of all its words; a text without words has none, is equal to other such texts, and links
with nothing. Nulls count as empty text. A null id counts as smaller than all others; rows
with equal ids must have equal texts or are told apart by their text's hash.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import components
from tidegrid.llm.storage import checked_broadcast, map_texts, split_batch, stored, text_or_empty

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 4
BLOCK_CLASSES = 512
BLOCK_GRAMS = 1 << 19
_WORD = re.compile(r"[^\W_]+")
_KEPT = 75_000


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """Least number of bands with 1 - (1 - threshold**rows)**bands >= recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _WordHashes(dict):
    """64-bit hashes by word, kept while there is room."""

    def __missing__(self, word: str) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word)
        if len(self) < _KEPT:
            self[word] = found
        return found


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size, count = min(n, len(h)), max(1, len(h) - n + 1)
    grams = np.full(count, size, np.uint64)
    for k in range(size):
        grams = _mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + count])
    return np.unique(grams)


@functools.lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    pick = np.random.default_rng(41)
    return pick.integers(1, 2**32, count, np.uint64) | np.uint64(1), pick.integers(0, 2**32, count, np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """One hash per band of a signature of bands x rows minima."""
    a, b = _permutations(bands * rows)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    minima = np.empty(bands * rows, np.uint64)
    for k in range(bands * rows):
        minima[k] = (low * np.uint32(a[k]) + np.uint32(b[k])).min()
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + minima[r::rows])
    return out


def classes(df: DataFrame, *, n: int = N, bands: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, row_hash, set_hash (null without n-grams), grams (their number), bands."""

    def rows(columns):
        import xxhash

        made = {"doc_id": columns["doc_id"], "row_hash": columns["row_hash"], "set_hash": [], "grams": [], "bands": []}
        for text in columns["text"]:
            grams = gram_set(text, n)
            made["grams"].append(len(grams))
            made["set_hash"].append(xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else None)
            made["bands"].append(band_hashes(grams, bands).view(np.int64).tolist() if len(grams) else [])
        return made

    text = text_or_empty(df, text_column)
    columns = [F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text")]
    return map_texts(df, columns, "doc_id bigint, row_hash bigint, set_hash string, grams bigint, bands array<bigint>", rows)


# Verification.


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right set, from the n-grams both sides have."""
    out = np.zeros((len(left), len(right)), np.int64)
    ls, rs = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(ls, rs)
    lrow, rrow = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    lat, rat = (np.searchsorted(common, x) for x in (ls, rs))
    lok, rok = (common[np.minimum(at, len(common) - 1)] == x if len(common) else np.zeros(len(x), bool) for at, x in ((lat, ls), (rat, rs)))
    lrow, lat, rrow, rat = lrow[lok], lat[lok], rrow[rok], rat[rok]
    step = max(1, (1 << 22) // (len(left) + len(right)))
    lorder, rorder = np.argsort(lat, kind="stable"), np.argsort(rat, kind="stable")
    lrow, lat, rrow, rat = lrow[lorder], lat[lorder], rrow[rorder], rat[rorder]
    for start in range(0, len(common), step):
        stop = min(start + step, len(common))
        a, b = np.zeros((len(left), stop - start), np.float32), np.zeros((len(right), stop - start), np.float32)
        li, lj = np.searchsorted(lat, (start, stop))
        ri, rj = np.searchsorted(rat, (start, stop))
        a[lrow[li:lj], lat[li:lj] - start] = 1
        b[rrow[ri:rj], rat[ri:rj] - start] = 1
        out += (a @ b.T).astype(np.int64)
    return out


def linked(left_sets, left_bands, right_sets, right_bands, threshold: float) -> np.ndarray:
    """Which pairs share a band hash and have a Jaccard similarity of at least ``threshold``."""
    share = np.zeros((len(left_sets), len(right_sets)), bool)
    for k in range(left_bands.shape[1]):
        share |= left_bands[:, k][:, None] == right_bands[:, k][None, :]
    sizes = np.array([len(s) for s in left_sets])[:, None] + np.array([len(s) for s in right_sets])[None, :]
    both = np.zeros(share.shape, np.int64)
    if len(left_sets) * len(right_sets) <= 64:
        for i, j in zip(*np.nonzero(share), strict=True):
            both[i, j] = len(np.intersect1d(left_sets[i], right_sets[j], assume_unique=True))
    elif share.any():
        both = _overlaps(left_sets, right_sets)
    return share & (both >= threshold * (sizes - both) - 1e-9)


def forest(ids: np.ndarray, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of positions, as pairs of ids."""
    parent, kept = list(range(len(ids))), []
    for i, j in pairs:
        a, b = i, j
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((int(ids[i]), int(ids[j])))
    return kept


_LINKS = "id bigint, links bigint, other bigint"


def _verified(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links of each task (group, i, j): rows (id, number of links, null) and forest edges (id, 0, other).

    ``members`` has group, i, j, side (0: block i, 1: block j), id, bands, text; partitions hold
    whole tasks in order.
    """
    schema = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sides = [[r for r in rows if r[1] == s] for s in (0, 1)]
        same = bool(rows) and rows[0][0][1] == rows[0][0][2]
        left, right = sides[0], sides[0] if same else sides[1]
        if not left or not right:  # a block can be empty
            return
        (ls, lb), (rs, rb) = (([r[4] for r in x], np.array([r[3] for r in x], np.int64)) for x in (left, right))
        found = linked(ls, lb, rs, rb, threshold)
        if same:
            np.fill_diagonal(found, False)
        ids = np.array([r[2] for r in (left if same else left + right)], np.int64)
        counts = found.sum(axis=1) if same else np.concatenate([found.sum(axis=1), found.sum(axis=0)])
        shift = 0 if same else len(left)
        edges = forest(ids, ((int(i), int(j) + shift) for i, j in zip(*np.nonzero(np.triu(found) if same else found), strict=True)))
        some = np.flatnonzero(counts)
        if len(some):
            made = [*zip(ids[some].tolist(), counts[some].tolist(), [None] * len(some), strict=True), *((a, 0, b) for a, b in edges)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            for part in split_batch(batch):
                columns = {c: part.column(k).to_pylist() for k, c in enumerate(part.schema.names)}
                for key, side, ident, bands, text in zip(zip(columns["group"], columns["i"], columns["j"], strict=True), columns["side"], columns["id"], columns["bands"], columns["text"], strict=True):
                    if key != task:
                        yield from settle(rows)
                        task, rows = key, []
                    rows.append((key, side, ident, bands, gram_set(text, n)))
        yield from settle(rows)

    return members.mapInArrow(run, _LINKS)


def jaccard_links(
    df: DataFrame, *, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the rows with the same n-grams), class_size,
    n_links (other classes within the threshold), group_id (smallest class of the connected group).
    """
    bands = band_count(threshold, ROWS, recall)
    rows = stored(classes(df, n=n, bands=bands, id_column=id_column, text_column=text_column), "ngram-classes")
    lead = F.min(F.struct("doc_id", "row_hash", "bands", "grams")).alias("lead")
    sets = rows.groupBy("set_hash").agg(lead, F.count(F.lit(1)).alias("class_size"))
    # A class is known by a number of its own inside, since ids may be null or repeat; writing the table fixes the numbers.
    sets = stored(sets.select("set_hash", "class_size", "lead.*", F.monotonically_increasing_id().alias("id")), "ngram-sets")
    real = sets.where("set_hash IS NOT NULL")
    keys = real.select("id", F.posexplode("bands").alias("band", "hash"))
    buckets = keys.groupBy("band", "hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = keys.join(buckets, ["band", "hash"]).where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    groups = stored(components(stars), "ngram-groups")

    sizes = real.join(groups, "id").groupBy("root").agg(F.count(F.lit(1)).alias("n_classes"), F.sum("grams").alias("n_grams"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_classes") / BLOCK_CLASSES), F.ceil(F.col("n_grams") / BLOCK_GRAMS)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"), (k < F.col("own")).cast("int").alias("side")),
    )
    placed = real.join(groups, "id").join(sizes.select("root", blocks.alias("blocks")), "root").withColumn("own", own)
    placed = placed.select("id", "doc_id", "row_hash", "bands", F.col("root").alias("group"), meets.alias("meets")).alias("p")
    text = text_or_empty(df, text_column)
    texts = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text")).alias("t")
    same_row = F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.row_hash") == F.col("p.row_hash"))
    members = texts.join(placed, same_row).select("id", "group", "bands", "text", F.explode("meets").alias("meet"))
    members = members.select("group", "meet.i", "meet.j", "meet.side", "id", "bands", "text").dropDuplicates(["group", "i", "j", "side", "id"])
    found = stored(_verified(members.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "id"), n, threshold), "ngram-links")

    counts = found.where("other IS NULL").groupBy("id").agg(F.sum("links").alias("n_links"))
    joined = components(found.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")))
    heads = sets.select("id", "doc_id", "row_hash").join(joined, "id").groupBy("root").agg(F.min(F.struct("doc_id", "row_hash")).alias("head"))
    named = sets.select("id", "set_hash", "class_size", F.col("doc_id").alias("class_id"), F.struct("doc_id", "row_hash").alias("own"))
    named = named.join(counts, "id", "left").join(joined, "id", "left").join(heads, "root", "left")
    named = named.select("set_hash", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("head", "own").alias("head"), "own")
    same_set = F.col("r.set_hash").eqNullSafe(F.col("c.set_hash"))
    kept = (F.struct("r.doc_id", "r.row_hash") == F.col("own")) & (F.col("own") == F.col("head"))
    return (
        rows.alias("r")
        .join(named.alias("c"), same_set)
        .select("r.doc_id", "r.row_hash", "class_id", "class_size", "n_links", F.col("head.doc_id").alias("group_id"), kept.alias("leads"))
    )


def one_of_each_group(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with all their columns, that lead their near-duplicate group; of repeated rows one stays."""
    links = jaccard_links(df, id_column=id_column, text_column=text_column, **options)
    links = stored(links.select("doc_id", "row_hash", "leads").groupBy("doc_id", "row_hash").agg(F.first("leads").alias("leads"), F.count(F.lit(1)).alias("n")), "ngram-leads")
    gone = checked_broadcast(links.where("NOT leads").select(F.col("doc_id").alias("_gone_id"), F.col("row_hash").alias("_gone_hash")))
    row_hash = F.xxhash64(text_or_empty(df, text_column))
    same_row = F.col(id_column).cast("bigint").eqNullSafe(F.col("_gone_id")) & (row_hash == F.col("_gone_hash"))
    left = df.join(gone, same_row, "left_anti")
    if links.where("leads AND n > 1").isEmpty():
        return left
    return left.withColumn("_row_hash", row_hash).dropDuplicates([id_column, "_row_hash"]).drop("_row_hash")
