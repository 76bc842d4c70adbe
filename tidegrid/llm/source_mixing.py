"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a target in words. A source gives each of its documents whole as often as
the target holds all of its words (complete epochs); what is left of the target is a weighted
sample without replacement. Document i gets the key ``-ln(u_i) / w_i`` with its quality weight
w_i; documents are sorted by key within their source, sizes are summed along that order, and
documents are taken until the budget is met (Efraimidis and Spirakis 2006, in its exponential
form). The document on which the budget ends gives its first words only, so a source's words
meet its target to the word.

No source is sorted in one task. Narrow rows (no texts) are range-partitioned by source and
key, so a part is a range of keys of a source; running sums are made within a part and shifted
by the sums of the parts before it. The targets come from one row per source.

``u`` is a hash of the seed and the id, so reruns and recomputed tasks agree. Null texts have
no words; null sources are one source, the last; a null id has the key of the empty id. A null
weight is 1, and a document with a weight of 0 or less comes after all others. Rows that are
equal in id, size, source and weight share a key and may swap places, which no result shows.
An empty table gives no rows. The table's further columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.storage import stored

SHARES = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
LABEL_WEIGHTS = {0: 1.0, 1: 4.0}
UNLABELLED_WEIGHT = 2.0


def label_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, weight`` per labelled id: what a known quality label makes of a document's chance."""
    known = labels.where(F.col("quality").isin(*LABEL_WEIGHTS)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.when(F.col("quality") == 1, F.lit(LABEL_WEIGHTS[1])).otherwise(F.lit(LABEL_WEIGHTS[0]))
    return known.select("doc_id", chosen.alias("weight"))


def source_targets(sizes: DataFrame, total: str = "source_size", shares: Sequence[int] = SHARES, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to one row per source, ordered by ``_s``: shares of all words, none above ``most`` times its own.

    Sharing an excess by weight until no source is above its limit ends at one level L with
    target = min(limit, weight * L). Sources reach their limits in the order of limit / weight,
    so those at their limit are a prefix of that order, found from running sums in integers.
    """
    wide = "decimal(38,0)"
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), (F.pmod(F.row_number().over(Window.orderBy("_s")) - 1, F.lit(len(shares))) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight.cast("bigint")).withColumn("_limit", F.col(total) * most)
    before = Window.orderBy(F.col("_limit") / F.col("_w"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = {
        "_words": F.sum(total).over(everything),
        "_weights": F.sum("_w").over(everything),
        "_limits_before": F.coalesce(F.sum("_limit").over(before), F.lit(0)),
        "_weights_before": F.coalesce(F.sum("_w").over(before), F.lit(0)),
    }
    room = (F.col("_words") - F.col("_limits_before")).cast(wide) * F.col("_w")
    capped = F.col("_limit").cast(wide) * (F.col("_weights") - F.col("_weights_before")) <= room
    rows = rows.withColumns(sums).withColumn("_capped", capped)
    taken = {
        "_limits": F.sum(F.when(F.col("_capped"), F.col("_limit")).otherwise(0)).over(everything),
        "_used": F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0)).over(everything),
    }
    share = ((F.col("_words") - F.col("_limits")) * F.col("_w")).cast("double") / (F.col("_weights") - F.col("_used"))
    target = F.when(F.col("_capped"), F.col("_limit").cast("double")).otherwise(share)
    return rows.withColumns(taken).select(*sizes.columns, target.alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """``-ln(u) / weight``: an exponential variable whose smallest values are a weighted sample."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)
    w = F.coalesce(weight.cast("double"), F.lit(1.0))
    return F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    shares: Sequence[int] = SHARES,
    most_repeats: int = MOST_REPEATS,
    seed: str = SEED,
    unknown_weight: float = 1.0,
) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, weight, epochs, taken``.

    ``weights`` has at most one ``weight`` per ``doc_id``; other documents get ``unknown_weight``.
    ``taken`` counts words with repeats: ``epochs`` whole passes and the part of the sample.
    """
    order = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        order.alias("_s"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
    )
    if weights is None:
        weighted = narrow.withColumn("weight", F.lit(float(unknown_weight)))
    else:
        known = weights.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("weight").cast("double").alias("_known"))
        weighted = narrow.join(known, "doc_id", "left").withColumn("weight", F.coalesce("_known", F.lit(float(unknown_weight)))).drop("_known")
    keyed = weighted.withColumn("_key", sampling_key(F.col("doc_id"), F.col("weight"), seed))
    # Sorted by source and key over all tasks; a part's number grows with its keys.
    ranged = stored(keyed.repartitionByRange("_s", "_key", "doc_id").withColumn("_part", F.spark_partition_id()), "mix-order")

    parts = ranged.groupBy("_s", "_part").agg(F.sum("size").alias("_part_size"))
    earlier = Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_part_size").over(earlier), F.lit(0)))
    targets = source_targets(parts.groupBy("_s").agg(F.sum("_part_size").alias("source_size")), shares=shares, most=most_repeats)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = targets.withColumn("epochs", F.least(epochs, F.lit(most_repeats).cast("bigint")))
    rest = F.floor(F.col("target") + 0.5).cast("bigint") - F.col("epochs") * F.col("source_size")
    rest = F.when(F.col("epochs") >= most_repeats, F.lit(0)).otherwise(rest).cast("bigint")
    starts = starts.drop("_part_size").join(plan.withColumn("_rest", rest), "_s")

    running = Window.partitionBy("_s", "_part").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_upto", F.sum("size").over(running)).join(starts, ["_s", "_part"])
    sampled = F.least(F.greatest(F.col("_rest") - (F.col("_start") + F.col("_upto") - F.col("size")), F.lit(0)), F.col("size"))
    source = F.when(F.col("_s") != "1", F.substr("_s", F.lit(2)))
    return summed.select(
        "doc_id", source.alias("source"), "size", "source_size", "target", "weight", "epochs",
        (F.col("epochs") * F.col("size") + sampled).alias("taken"),
    )


def mixed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as ``plan`` takes it, with all its columns.

    ``copy`` counts a document's repeats from 1; the last one holds the first words only where
    the budget ends inside the document. Ids must be unique.
    """
    chosen = plan.where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    copies = docs.join(chosen, F.col("doc_id") == F.col("_id")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int")))
    )
    left = (F.col("_taken") - (F.col("copy") - 1) * F.col("_size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.when(left >= F.col("_size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), left), " "))
    return copies.withColumn("text", cut).drop("_id", "_size", "_taken")
