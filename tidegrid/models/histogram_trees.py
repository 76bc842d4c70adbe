"""Many boosted quantile fits grown together over one binned table.

Features are binned once to small integers and packed to blocks of rows, which stay cached with
the running forecast of every fit on every row. A pass over the blocks counts rows per fit,
node, feature and bin, and how many of them lie at or below the forecast; the pinball gradient
takes two values only, so these two counts give every split's gain exactly. One pass grows one
level of the current tree of all fits, and one more finds the quantile of the residuals in all
leaves; leaves of very many residuals take a few more, each over a narrower span around the
quantile, which is exact at every size. Passes per round depend on the depth alone: fits of other quantiles, candidates, targets
and row sets add columns to the same pass and no jobs.

With few partitions the counts come to the driver, as many as a tree level has cells; with more
they are summed by fit in a shuffle and only the chosen splits come. Both add the same integers.
A table of at most ``TASK_ROWS`` rows is one partition and needs no sums across tasks: its fits
are dealt to tasks, each of which makes the same passes by itself. Forecasts are checkpointed every ``ROUNDS_PER_CHECKPOINT`` rounds, so a lost executor costs a
replay of those at most.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import cut_lineage

BINS = 32
SKETCH_ACCURACY = 10_000
#: Distinct residuals of a leaf that one pass keeps; of more it keeps evenly spaced ranks, and further passes narrow down to the quantile.
LEAF_VALUES = 10_000
ROUNDS_PER_CHECKPOINT = 25
#: Partitions whose counts the driver sums itself.
DIRECT_PARTITIONS = 32
#: Rows of a partition at most; a smaller table is one partition.
TASK_ROWS, BLOCK_ROWS = 1 << 17, 1 << 13


@dataclass(frozen=True)
class Fit:
    """One boosted model: the target's number, the rows (splits up to a code), features and settings."""

    target: int
    last_split: int
    features: tuple[int, ...]
    alpha: float
    rounds: int
    rate: float
    depth: int
    least: int
    subsample: float = 1.0
    seed: int = 0


@dataclass
class Grown:
    """A tree by heap number: node i has children 2i + 1 and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Grown:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size))

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            feature = self.feature[node]
            right = x[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Block:
    """Rows of the binned table, and per fit the running forecast."""

    number: int
    x: np.ndarray
    y: np.ndarray
    split: np.ndarray
    margin: np.ndarray

    def rows(self, fit: Fit, round_number: int | None = None) -> np.ndarray:
        """Rows a fit learns from; with a round, the ones drawn for it."""
        use = (self.split <= fit.last_split) & ~np.isnan(self.y[:, fit.target])
        if round_number is not None and fit.subsample < 1:
            draw = np.random.default_rng([fit.seed, round_number, self.number])
            use &= draw.random(len(use)) < fit.subsample
        return np.flatnonzero(use)


@dataclass
class BinnedRows:
    blocks: RDD
    thresholds: list[np.ndarray]


def bin_rows(df: DataFrame, *, features: Sequence[str], targets: Sequence[str], split: str | None = None) -> BinnedRows:
    """Bin the features by quantiles of the rows with split code 0; rows without a feature are left out.

    ``split`` names an integer column; without one every row has code 0.
    """
    code = F.col(split) if split else F.lit(0)
    table = df.dropna(subset=list(features)).select(
        code.cast("int").alias("_split"),
        *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(features)],
        *[F.col(c).cast("double").alias(f"_y{k}") for k, c in enumerate(targets)],
    )
    table = cut_lineage(table)
    probabilities = [k / BINS for k in range(1, BINS)]
    cuts = [F.percentile_approx(F.when(F.col("_split") == 0, F.col(f"_x{k}")), probabilities, SKETCH_ACCURACY) for k in range(len(features))]
    first = table.agg(F.count(F.lit(1)).alias("n"), *[c.alias(f"c{k}") for k, c in enumerate(cuts)]).first()
    thresholds = [np.unique(np.array(first[f"c{k}"] or [], float)) for k in range(len(features))]
    parallel = df.sparkSession.sparkContext.defaultParallelism
    parts = 1 if first["n"] <= TASK_ROWS else max(min(-(-first["n"] // BLOCK_ROWS), 2 * parallel), -(-first["n"] // TASK_ROWS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                read = lambda k: batch.column(k).to_numpy(zero_copy_only=False)
                x = np.stack([np.searchsorted(t, read(1 + k)) for k, t in enumerate(thresholds)], axis=1).astype(np.uint8)
                y = np.stack([read(1 + len(thresholds) + k).astype(float) for k in range(len(targets))], axis=1)
                packed = pickle.dumps((number, x, y, read(0)))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["block"])

    packed = cut_lineage(table.repartition(parts).mapInArrow(pack, "block binary"))
    return BinnedRows(packed.rdd.map(lambda row: pickle.loads(row["block"])), thresholds)


# Passes over the blocks.


def _level_counts(block: Block, fits: Sequence[Fit], trees: dict[int, Grown], level: int, round_number: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per fit: rows by node of the level, feature and bin, above and not above the forecast."""
    width = block.x.shape[1]
    shape = (2**level, width, BINS, 2)
    for k, tree in trees.items():
        fit = fits[k]
        if level >= fit.depth:
            continue
        rows = block.rows(fit, round_number)
        x = block.x[rows]
        node = tree.nodes(x, level) - (2**level - 1)
        below = block.y[rows, fit.target] <= block.margin[k, rows]
        if level:
            inside = node >= 0
            x, node, below = x[inside], node[inside], below[inside]
        cell = ((node[:, None] * width + np.arange(width)) * BINS + x) * 2 + below[:, None]
        yield k, np.bincount(cell.ravel(), minlength=int(np.prod(shape))).reshape(shape)


def best_splits(counts: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """Feature and bin of every node's best split by the gradient's variance; -1 where none helps."""
    upto = counts[:, list(fit.features)].cumsum(axis=2)
    n, low = upto.sum(axis=3), upto[..., 1]
    left, all_rows = n[:, :, :-1], n[:, :, -1:]
    right = all_rows - left
    g_left, g_all = fit.alpha * left - low[:, :, :-1], fit.alpha * all_rows - low[:, :, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g_left**2 / left + (g_all - g_left) ** 2 / right - g_all**2 / all_rows
    gain = np.where((left >= fit.least) & (right >= fit.least) & (left > 0) & (right > 0), gain, 0.0)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), best] > 1e-12
    return np.where(found, np.array(fit.features)[best // (BINS - 1)], -1), best % (BINS - 1)


Summary = tuple[np.ndarray, np.ndarray]


def merged(*parts: Summary) -> Summary:
    """Sorted distinct values with weights; thinned to evenly spaced ranks beyond ``LEAF_VALUES``."""
    return _merged(*parts)[0]


def _merged(*parts: Summary) -> tuple[Summary, bool]:
    """The merged summary, and whether it holds every value."""
    values, weights = (np.concatenate(some) for some in zip(*parts))
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    last = np.append(values[1:] != values[:-1], True)[: len(values)]
    values, upto = values[last], upto[last]
    whole = len(values) <= LEAF_VALUES
    if not whole:
        ranks = -(-upto[-1] * np.arange(1, LEAF_VALUES + 1) // LEAF_VALUES)
        at = np.unique(np.searchsorted(upto, ranks))
        values, upto = values[at], upto[at]
    return (values, np.diff(upto, prepend=0)), whole


def lower_rank(alpha: float, n: int) -> int:
    """The least rank with at least a share ``alpha`` of ``n`` at or below it; the share counts as it is written."""
    return max(1, math.ceil(Fraction(str(float(alpha))) * int(n)))


def lower_quantile(summary: Summary, alpha: float) -> float:
    """The smallest value with at least a share ``alpha`` of the weight at or below it."""
    values, weights = summary
    upto = np.cumsum(weights)
    return float(values[np.searchsorted(upto, lower_rank(alpha, upto[-1]))])


Leaf = tuple[int, int]
#: Residuals above the first and up to the second value.
Span = tuple[float, float]
EVERYTHING: Span = (-np.inf, np.inf)


@dataclass
class Inside:
    """Residuals of a leaf: how many lie at or before the start of a span, and a summary of those inside."""

    below: int
    summary: Summary
    whole: bool

    @classmethod
    def of(cls, rest: np.ndarray, span: Span) -> Inside:
        low, high = span
        here = rest if span == EVERYTHING else rest[(rest > low) & (rest <= high)]
        below = 0 if span == EVERYTHING else int((rest <= low).sum())
        return cls(below, *_merged((here, np.ones(len(here), np.int64))))

    def __add__(self, other: Inside) -> Inside:
        summary, whole = _merged(self.summary, other.summary)
        return Inside(self.below + other.below, summary, whole and self.whole and other.whole)


@dataclass
class Search:
    """A rank of a leaf's residuals, a span that surely holds it and the narrower one to look at."""

    rank: int
    known: Span
    guess: Span


def located(seen: Inside, search: Search) -> float | Search:
    """The value of the rank if ``seen`` decides it, else a narrower search.

    The known span loses values each time, so a wrong guess, which the errors of thinned
    summaries may lead to, costs a pass and nothing else.
    """
    (values, weights), (low, high) = seen.summary, search.guess
    upto, rank = np.cumsum(weights), search.rank - seen.below
    if rank < 1:
        span = (search.known[0], low)
        return Search(search.rank, span, span)
    if not len(upto) or rank > upto[-1]:
        span = (high, search.known[1])
        return Search(search.rank, span, span)
    if seen.whole:
        return float(values[np.searchsorted(upto, rank)])
    slack = upto[-1] // 100
    first, last = np.searchsorted(upto, [rank - slack, rank + slack])
    guess = (float(values[first - 1]) if first else low, float(values[last]) if last < len(values) - 1 else high)
    if guess == (low, high):  # one value holds most rows: look at that value alone
        value = float(values[np.searchsorted(upto, rank)])
        guess = (float(np.nextafter(value, -np.inf)), value)
    return Search(search.rank, (low, high), guess)


def _residuals(
    block: Block, fits: Sequence[Fit], trees: dict[int, Grown], searches: dict[Leaf, Search] | None
) -> Iterator[tuple[Leaf, Inside]]:
    """Per fit and leaf: the residuals, or those in the spans searched."""
    searched = None if searches is None else {k for k, _ in searches}
    for k, tree in trees.items():
        fit = fits[k]
        if searched is not None and k not in searched:
            continue
        rows = block.rows(fit)
        if not len(rows):
            continue
        leaf = tree.nodes(block.x[rows], fit.depth)
        rest = block.y[rows, fit.target] - block.margin[k, rows]
        order = np.lexsort((rest, leaf))
        leaf, rest = leaf[order], rest[order]
        for part in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
            key = (k, int(leaf[part[0]]))
            if searches is None:
                yield key, Inside.of(rest[part], EVERYTHING)
            elif key in searches:
                yield key, Inside.of(rest[part], searches[key].guess)


def _quantiles(passes: Passes, fits: Sequence[Fit], trees: dict[int, Grown]) -> dict[Leaf, float]:
    """The quantile of the residuals in every leaf, exact: one pass, and more for leaves of very many residuals."""
    found: dict[Leaf, float] = {}
    searches: dict[Leaf, Search] | None = None

    def finish(key: Leaf, seen: Inside) -> float | Search:
        if searches is None:
            rank = lower_rank(fits[key[0]].alpha, seen.summary[1].sum())
            return located(seen, Search(rank, EVERYTHING, EVERYTHING))
        return located(seen, searches[key])

    while searches is None or searches:
        seen = passes.reduce(lambda b: _residuals(b, fits, trees, searches), Inside.__add__, finish)  # noqa: B023
        found |= {key: value for key, value in seen.items() if not isinstance(value, Search)}
        searches = {key: value for key, value in seen.items() if isinstance(value, Search)}
    return found


Measure = Callable[[Block], Iterator[tuple]]


def _sums(blocks: Iterable[Block], measure: Measure, add: Callable) -> dict:
    sums: dict = {}
    for block in blocks:
        for key, value in measure(block):
            sums[key] = add(sums[key], value) if key in sums else value
    return sums


class LocalPasses:
    """Passes over the blocks of a single partition, inside its task."""

    def __init__(self, blocks: list[tuple], base: np.ndarray) -> None:
        self.blocks = [_started(b, base) for b in blocks]

    def reduce(self, measure: Measure, add: Callable, finish: Callable) -> dict:
        """``finish`` of the sums, by key, of what ``measure`` yields for each block."""
        return {key: finish(key, value) for key, value in _sums(self.blocks, measure, add).items()}

    def advance(self, fits: Sequence[Fit], trees: dict[int, Grown], round_number: int) -> None:
        self.blocks = [_advanced(b, fits, trees) for b in self.blocks]


class SparkPasses:
    """The same passes over the partitions of a cached table, one job each."""

    def __init__(self, blocks: RDD, base: np.ndarray) -> None:
        self.old: RDD | None = None
        self.state = blocks.map(lambda b: _started(b, base)).persist(StorageLevel.MEMORY_AND_DISK)

    def reduce(self, measure: Measure, add: Callable, finish: Callable) -> dict:
        parts = self.state.mapPartitions(lambda blocks: iter(_sums(blocks, measure, add).items()))
        if self.state.getNumPartitions() > DIRECT_PARTITIONS:
            found = dict(parts.reduceByKey(add).map(lambda kv: (kv[0], finish(*kv))).collect())
        else:
            sums: dict = {}
            for key, value in parts.collect():
                sums[key] = add(sums[key], value) if key in sums else value
            found = {key: finish(key, value) for key, value in sums.items()}
        if self.old is not None:  # the pass has computed the state that follows it
            self.old.unpersist()
            self.old = None
        return found

    def advance(self, fits: Sequence[Fit], trees: dict[int, Grown], round_number: int) -> None:
        following = self.state.map(lambda b: _advanced(b, fits, trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if round_number % ROUNDS_PER_CHECKPOINT == 0:
            following.checkpoint()
        self.old, self.state = self.state, following

    def close(self) -> None:
        for state in (self.old, self.state):
            if state is not None:
                state.unpersist()


def _started(block: tuple, base: np.ndarray) -> Block:
    return Block(*block, np.repeat(base[:, None], len(block[1]), axis=1))


def _advanced(block: Block, fits: Sequence[Fit], trees: dict[int, Grown]) -> Block:
    margin = block.margin.copy()
    for k, tree in trees.items():
        margin[k] += fits[k].rate * tree.value[tree.nodes(block.x, fits[k].depth)]
    return Block(block.number, block.x, block.y, block.split, margin)


Passes = LocalPasses | SparkPasses


def _bases(passes: Passes, fits: Sequence[Fit]) -> np.ndarray:
    """The quantile of every fit's target."""
    stumps = {k: Grown.empty(0) for k in range(len(fits))}
    found = _quantiles(passes, fits, stumps)
    if any((k, 0) not in found for k in stumps):
        raise ValueError("no complete training row")
    return np.array([found[k, 0] for k in stumps])


def _rounds(passes: Passes, fits: Sequence[Fit]) -> list[list[Grown]]:
    """All rounds of all fits: a pass per level of the trees, and one for the leaves."""
    trees: list[list[Grown]] = [[] for _ in fits]
    for number in range(1, max(fit.rounds for fit in fits) + 1):
        grown = {k: Grown.empty(fit.depth) for k, fit in enumerate(fits) if fit.rounds >= number}
        for level in range(max(fits[k].depth for k in grown)):
            counts = lambda b: _level_counts(b, fits, grown, level, number)  # noqa: B023, E731
            splits = passes.reduce(counts, np.add, lambda k, c: best_splits(c, fits[k]))
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            for k, (feature, cut) in splits.items():
                grown[k].feature[nodes], grown[k].cut[nodes] = feature, cut
            if not any((feature >= 0).any() for feature, _ in splits.values()):
                break
        for (k, leaf), value in _quantiles(passes, fits, grown).items():
            grown[k].value[leaf] = value
        for k, tree in grown.items():
            trees[k].append(tree)
        passes.advance(fits, grown, number)
    return trees


def grow(binned: BinnedRows, fits: Sequence[Fit]) -> tuple[list[float], list[list[Grown]]]:
    """Base forecast and trees of every fit.

    A table of one partition has nothing to sum across tasks, so its fits are dealt to tasks
    that each run all rounds over it; otherwise every pass is a job over all partitions.
    """
    fits = list(fits)
    zero = np.zeros(len(fits))
    if binned.blocks.getNumPartitions() > 1:
        passes = SparkPasses(binned.blocks, zero)
        base = _bases(passes, fits)
        passes.close()
        passes = SparkPasses(binned.blocks, base)
        trees = _rounds(passes, fits)
        passes.close()
        return base.tolist(), trees

    groups = max(1, min(len(fits), binned.blocks.context.defaultParallelism))

    def run(arrived: Iterator[tuple]) -> Iterator[tuple]:
        blocks, mine = [], None
        for group, block in arrived:
            blocks.append(block)
            mine = range(group, len(fits), groups)
        if mine is None:
            return
        own = [fits[k] for k in mine]
        base = _bases(LocalPasses(blocks, np.zeros(len(own))), own)
        for k, start, trees in zip(mine, base.tolist(), _rounds(LocalPasses(blocks, base), own)):
            yield k, start, trees

    copies = binned.blocks.flatMap(lambda b: [(g, b) for g in range(groups)])
    done = sorted(copies.partitionBy(groups, lambda g: g).mapPartitions(run).collect(), key=lambda r: r[0])
    if len(done) < len(fits):
        raise ValueError("no complete training row")
    return [start for _, start, _ in done], [trees for _, _, trees in done]
