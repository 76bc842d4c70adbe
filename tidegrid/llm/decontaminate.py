"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame operations only.

Texts and items become words (runs of letters and digits, lower-cased) and word shingles. For
each item, the windows of a document that are as long as the item are fingerprinted and looked
up in a multi-index: the 64 fingerprint bits are cut into ``RADIUS + 1`` blocks, so two
fingerprints within the radius agree on at least one block, and an equality join on block and
bits finds every pair within it. Pairs within the radius are verified by their exact weighted
shingle similarity: the sum of the smaller over the sum of the larger weights, where a shingle
weighs as often as it occurs.

Only windows that can reach the threshold are fingerprinted. A window and an item of ``g``
shingles each with similarity ``t`` have at least ``2 t g / (1 + t)`` shingles in common, so a
first pass joins the shingles of all documents with those of the items and keeps every window
with that many matching places; this loses none. A document of fewer words than the item is its
own window: with ``h`` shingles it needs ``t (g + h) / (1 + t)`` in common. Only the items' shingles and the list of such
windows may be broadcast, and only up to ``BROADCAST_ROWS`` rows; beyond, the same joins shuffle.

An item of fewer words than a shingle is one shingle of all its words; an item without words
matches nothing. Nulls count as empty text. Repeated rows of one id are reported once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import checked_broadcast, stored, text_or_empty

N = 5
THRESHOLD = 0.8
#: Similar windows (0.8) differ in about 10 of 64 bits, with a deviation of about 3.
RADIUS = 19
BITS = 64
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingles(hashes: Column, n: int) -> Column:
    """Hashes of the runs of ``n`` words, one per start; empty if there are fewer words."""
    at = lambda i, k: F.get(hashes, i + k)
    starts = F.sequence(F.lit(0), F.size(hashes) - n)
    made = F.transform(starts, lambda i: F.xxhash64(*(at(i, k) for k in range(n))))
    return F.when(F.size(hashes) >= n, made).otherwise(F.array().cast("array<bigint>"))


def simhash(grams: Column) -> Column:
    """64 signs of the sums over shingles of +1 for a set bit, -1 for a clear one."""
    ones = lambda b: F.aggregate(grams, F.lit(0), lambda s, g: s + F.shiftrightunsigned(g, b).bitwiseAND(F.lit(1)).cast("int"))
    bits = (F.when(2 * ones(b) >= F.size(grams), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint") for b in range(BITS))
    total = F.lit(0).cast("bigint")
    for bit in bits:
        total = total.bitwiseOR(bit)
    return total


def block_keys(fingerprint: Column, blocks: int = RADIUS + 1) -> Column:
    """(block, bits) for every block; any two fingerprints within ``blocks - 1`` bits share one."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = (
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))
    )
    return F.array(*parts)


def weighted_similarity(left: Column, right: Column) -> Column:
    """Sum of the smaller over sum of the larger numbers of occurrences."""
    count = lambda a, x: F.size(a) - F.size(F.array_remove(a, x))
    smaller = F.aggregate(F.array_distinct(left), F.lit(0), lambda s, x: s + F.least(count(left, x), count(right, x)))
    return smaller / F.greatest(F.size(left) + F.size(right) - smaller, F.lit(1))


def _grams(hashes: Column, width: Column, n: int) -> Column:
    """Shingles of ``width`` words, for widths up to ``n``."""
    return F.coalesce(*(F.when(width == k, shingles(hashes, k)) for k in range(n, 0, -1)))


def item_table(items: DataFrame, n: int = N, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Per item with words: item_id, size (words), width (words of a shingle), grams, print."""
    hashed = items.select(F.col(item_column).alias("item_id"), word_hashes(text_or_empty(items, text_column)).alias("w")).where(F.size("w") > 0)
    hashed = hashed.withColumn("size", F.size("w")).withColumn("width", F.least("size", F.lit(n)))
    hashed = hashed.withColumn("grams", _grams(F.col("w"), F.col("width"), n))
    return stored(hashed.withColumn("print", simhash(F.col("grams"))).drop("w"), "items")


def candidate_starts(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, row_hash, size, width, starts): windows with enough places that match shingles of one item.

    ``docs`` has doc_id, row_hash and w, the word hashes. With the matching places of a document in
    order, windows whose first match is place i start after the match before it, and late enough
    to hold the match that makes up the number needed.
    """
    index = items.select("item_id", "print", "width", "size", F.size("grams").alias("g"), F.explode("grams").alias("gram")).distinct()
    index, parts = stored(index, "item-shingles"), []
    small = index.count() <= BROADCAST_ROWS
    for width in sorted(r.width for r in items.select("width").distinct().collect()):  # at most n values
        some = index.where(F.col("width") == width)
        places = docs.select("doc_id", "row_hash", F.size("w").alias("length"), F.posexplode(shingles(F.col("w"), width)).alias("place", "gram"))
        parts.append(places.join(F.broadcast(some) if small else some, "gram"))
    hits = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "row_hash", "length", "item_id", "print", "width", "size", "g")
    own = F.least("g", F.col("length") - F.col("width") + 1)  # shingles of the window
    needed = F.ceil(threshold / (1 + threshold) * (F.col("g") + own) - 1e-9).cast("int")
    hits = hits.agg(F.sort_array(F.collect_set("place")).alias("p")).withColumn("needed", needed).where(F.size("p") >= F.col("needed"))
    last = lambda i: F.get("p", i + F.col("needed") - 1)
    low = lambda i: F.greatest(F.coalesce(F.get("p", i - 1) + 1, F.lit(0)), last(i) - F.col("g") + 1)
    high = lambda i: F.least(F.get("p", i), F.greatest(F.col("length") - F.col("size"), F.lit(0)))
    from_match = lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(F.array().cast("array<int>"))
    starts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("p") - F.col("needed")), from_match)).alias("starts")
    return hits.select("doc_id", "row_hash", "size", "width", starts).where(F.size("starts") > 0)


def contamination(
    docs: DataFrame, items: DataFrame, *, n: int = N, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id"
) -> DataFrame:
    """Per window and item within the threshold: doc_id, item_id, start (word), n_words, distance (bits), similarity.

    Several windows of a document can match one item; each is reported once.
    """
    items = item_table(items, n, item_column)
    if items.isEmpty():
        schema = "doc_id bigint, item_id bigint, start int, n_words int, distance int, similarity double"
        return docs.sparkSession.createDataFrame([], schema)
    text = text_or_empty(docs, text_column)
    docs = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    starts = candidate_starts(docs.select("doc_id", "row_hash", word_hashes(F.col("text")).alias("w")), items, n, threshold)
    starts = stored(starts, "window-starts")
    same_row = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.row_hash") == F.col("s.row_hash"))
    found = docs.alias("d").join(checked_broadcast(starts, BROADCAST_ROWS).alias("s"), same_row)
    found = found.select("d.doc_id", "size", "width", "starts", word_hashes(F.col("text")).alias("w"))
    found = found.select("doc_id", "size", "width", "w", F.explode("starts").alias("start"))
    windows = found.select("doc_id", "start", "size", "width", F.slice("w", F.col("start") + 1, F.col("size")).alias("w")).distinct()
    windows = windows.withColumn("grams", _grams(F.col("w"), F.col("width"), n)).withColumn("n_words", F.size("w")).drop("w", "width")
    windows = stored(windows.withColumn("print", simhash(F.col("grams"))), "windows")

    keyed = windows.select("*", F.explode(block_keys(F.col("print"))).alias("key")).select("*", "key.*").drop("key")
    item_keys = items.select("item_id", "size", F.col("grams").alias("item_grams"), F.col("print").alias("item_print"), F.explode(block_keys(F.col("print"))).alias("key"))
    item_keys = item_keys.select("*", "key.*").drop("key")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = keyed.join(item_keys, ["size", "block", "bits"]).where(distance <= RADIUS)
    pairs = pairs.dropDuplicates(["doc_id", "start", "size", "print", "item_id", "item_print"])
    return (
        pairs.withColumn("similarity", weighted_similarity(F.col("grams"), F.col("item_grams")))
        .where(F.col("similarity") >= threshold)
        .select("doc_id", "item_id", "start", "n_words", distance.cast("int").alias("distance"), "similarity")
        .distinct()
    )


def clean_documents(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, without a window within the threshold of an item."""
    found = stored(contamination(docs, items, id_column=id_column, **options).select(F.col("doc_id").alias("_leak_id")).distinct(), "leaks")
    return docs.join(checked_broadcast(found), F.col(id_column).cast("bigint").eqNullSafe(F.col("_leak_id")), "left_anti")
