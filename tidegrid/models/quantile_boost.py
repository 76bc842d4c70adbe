"""Quantile gradient boosting, with candidate search and refit.

Each round fits a regression tree to the pinball gradient, replaces its leaf
values by the quantile of the residuals in the leaf, and adds the scaled tree to
the running forecast. All quantiles, candidates, horizons, feature sets and row sets
grow in the same passes (see ``histogram_trees``); only trees come to the driver.
Candidates that differ in the number of rounds alone are one fit, cut short.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.models.histogram_trees import Fit, Grown, bin_rows, grow
from tidegrid.operators.fill import drop_incomplete, impute_train_median
from tidegrid.operators.metrics import QUANTILES, metric_table
from tidegrid.operators.splits import before_test
from tidegrid.session import cut_lineage
from tidegrid.sources.constants import BOOST_CANDIDATES, TASK

@dataclass
class Tree:
    """A binary tree as parallel arrays; a leaf points to itself."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    @classmethod
    def from_grown(cls, grown: Grown, thresholds: Sequence[np.ndarray]) -> Tree:
        tree = cls()

        def visit(node: int) -> int:
            at, feature = len(tree.value), int(grown.feature[node])
            for array, start in (
                (tree.feature, 0), (tree.threshold, np.inf), (tree.left, at), (tree.right, at),
                (tree.value, float(grown.value[node])),
            ):
                array.append(start)
            if feature >= 0:
                tree.feature[at] = feature
                tree.threshold[at] = float(thresholds[feature][grown.cut[node]])
                tree.left[at] = visit(2 * node + 1)
                tree.right[at] = visit(2 * node + 2)
            return at

        visit(0)
        return tree

    def walk(self, features: Sequence[str], leaf: Sequence[object], at: int = 0) -> Column:
        """Nested comparison that yields ``leaf[i]`` for rows ending in leaf i."""
        if self.left[at] == at:
            return F.lit(leaf[at])
        goes_left = F.col(features[self.feature[at]]) <= self.threshold[at]
        return F.when(goes_left, self.walk(features, leaf, self.left[at])).otherwise(
            self.walk(features, leaf, self.right[at])
        )

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        rows, node = np.arange(len(x)), np.zeros(len(x), dtype=int)
        while True:
            goes_left = x[rows, feature[node]] <= threshold[node]
            following = np.where(goes_left, left[node], right[node])
            if np.array_equal(following, node):
                return np.array(self.value)[node]
            node = following


@dataclass
class QuantileBoostModel:
    features: Sequence[str]
    base: float
    learning_rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self.learning_rate * tree.predict(x)
        return total


def _fit(config: Mapping[str, object], alpha: float, *, target: int, last_split: int, features: tuple[int, ...], seed: int) -> Fit:
    return Fit(
        target, last_split, features, alpha, int(config["n_estimators"]), float(config["learning_rate"]),
        int(config["max_depth"]), int(config["min_samples_leaf"]), float(config["subsample"]), seed,
    )


def _fitted(
    df: DataFrame, fits: Sequence[Fit], *, features: Sequence[str], targets: Sequence[str], split: str | None
) -> list[QuantileBoostModel]:
    """A model for every fit; fits that differ in their rounds alone are grown once."""
    shared: dict[Fit, int] = {}
    for fit in fits:
        key = replace(fit, rounds=0)
        shared[key] = max(shared.get(key, 0), fit.rounds)
    binned = bin_rows(df, features=features, targets=targets, split=split)
    base, trees = grow(binned, [replace(key, rounds=rounds) for key, rounds in shared.items()])
    number = {key: k for k, key in enumerate(shared)}
    models = []
    for fit in fits:
        k = number[replace(fit, rounds=0)]
        taken = [Tree.from_grown(t, binned.thresholds) for t in trees[k][: fit.rounds]]
        models.append(QuantileBoostModel(list(features), base[k], fit.rate, taken))
    return models


def fit_candidates(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    candidates: Sequence[Mapping[str, object]],
    quantiles: Mapping[str, float] = QUANTILES,
    seed: int = TASK["random_seed"],
) -> list[dict[str, QuantileBoostModel]]:
    """Models of every quantile level for each candidate, from all rows of ``df``."""
    every = tuple(range(len(features)))
    fits = [
        _fit(config, alpha, target=0, last_split=0, features=every, seed=seed)
        for config in candidates
        for alpha in quantiles.values()
    ]
    models = iter(_fitted(df, fits, features=features, targets=[target], split=None))
    return [{name: next(models) for name in quantiles} for _ in candidates]


def fit_quantile_boost(
    df: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    alpha: float,
    config: Mapping[str, object],
    seed: int = TASK["random_seed"],
) -> QuantileBoostModel:
    """Fit one quantile level; rows with a missing feature or target are skipped."""
    fitted = fit_candidates(
        df, target=target, features=features, candidates=[config], quantiles={"q": alpha}, seed=seed
    )
    return fitted[0]["q"]


def predict_quantiles(df: DataFrame, models: Mapping[str, QuantileBoostModel]) -> DataFrame:
    """Add one column per model; all trees run on an Arrow batch at once, in one transfer."""
    fitted = dict(models)
    names = list(next(iter(fitted.values())).features)
    schema = ", ".join(f"{c} double" for c in fitted)

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            yield pd.DataFrame({c: m.predict(x) for c, m in fitted.items()})

    inputs = F.struct(*[F.col(c).cast("double").alias(c) for c in names])
    return df.withColumn("_q", score(inputs)).select(*df.columns, "_q.*")


def prepare_features(
    df: DataFrame, *, target: str, features: Sequence[str], impute: Sequence[str] = ()
) -> DataFrame:
    """Impute by the training median, then drop rows with a missing feature or target."""
    return drop_incomplete(impute_train_median(df, impute), [*features, target])


@dataclass
class Search:
    """Models of one target and feature set: per candidate, as fitted on train and on all before the test."""

    label: str
    target: str
    feature_set: str
    on_train: list[dict[str, QuantileBoostModel]]
    refitted: list[dict[str, QuantileBoostModel]]


def fit_searches(
    df: DataFrame,
    *,
    targets: Mapping[str, str],
    feature_sets: Mapping[str, Sequence[str]],
    candidates: Sequence[Mapping[str, object]] = BOOST_CANDIDATES,
    refit: bool = True,
    seed: int = TASK["random_seed"],
) -> list[Search]:
    """All candidates of all targets and feature sets on train and, with ``refit``, on train and validation.

    The refits grow in the passes of the search: their number of rounds decides the time, and
    waiting for the choice would double it. Features missing in a row leave it out of all fits.
    """
    names = list(dict.fromkeys(f for features in feature_sets.values() for f in features))
    columns = list(dict.fromkeys(targets.values()))
    code = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1)
    rows = before_test(df).withColumn("_code", code)
    ends = (0, 1) if refit else (0,)
    fits = [
        _fit(config, alpha, target=columns.index(target), last_split=end, features=tuple(map(names.index, features)), seed=seed)
        for target in targets.values()
        for features in feature_sets.values()
        for end in ends
        for config in candidates
        for alpha in QUANTILES.values()
    ]
    models = iter(_fitted(rows, fits, features=names, targets=columns, split="_code"))
    return [
        Search(label, target, feature_set, *([{q: next(models) for q in QUANTILES} for _ in candidates] if end in ends else [] for end in (0, 1)))
        for label, target in targets.items()
        for feature_set in feature_sets
    ]


def _scored(df: DataFrame, models: Sequence[tuple[Mapping[str, object], Mapping[str, QuantileBoostModel]]]) -> DataFrame:
    """``df`` once per entry: its constant columns, and the quantiles of its models as ``QUANTILES`` names them.

    All models run on an Arrow batch at once; the rows are copied afterwards.
    """
    flat = {f"m{k}_{q}": model for k, (_, models_of) in enumerate(models) for q, model in models_of.items()}
    wide = predict_quantiles(df, flat)
    entries = F.array(*[
        F.struct(*[F.lit(v).alias(c) for c, v in constants.items()], *[F.col(f"m{k}_{q}").alias(q) for q in models_of])
        for k, (constants, models_of) in enumerate(models)
    ])
    return wide.select(*df.columns, F.inline(entries))


def _candidate_metrics(df: DataFrame, searches: Sequence[Search], candidates: Sequence[Mapping[str, object]]) -> DataFrame:
    """Validation metrics of every candidate; ``selected`` marks the lowest median pinball loss, the first of ties."""
    validation, tables = df.where(F.col("split") == "validation"), []
    by_target: dict[str, list] = {}
    for search in searches:
        for number, (config, models) in enumerate(zip(candidates, search.on_train)):
            constants = {"horizon": search.label, "feature_set": search.feature_set, "candidate": number, "model_name": config["name"]}
            by_target.setdefault(search.target, []).append((constants, models))
    for target, models in by_target.items():
        scored = _scored(validation, models)
        tables.append(metric_table(scored, actual=target, by=["horizon", "feature_set", "candidate", "model_name"]))
    results = cut_lineage(reduce(DataFrame.unionByName, tables))
    group = ["horizon", "feature_set"]
    best = results.groupBy(*group).agg(F.min_by("candidate", F.struct("pinball_q50", "candidate")).alias("_best"))
    return results.join(best, group).withColumn("selected", F.col("candidate") == F.col("_best")).drop("_best")


def _choices(results: DataFrame) -> dict[tuple[str, str], int]:
    return {(r.horizon, r.feature_set): r.candidate for r in results.where("selected").collect()}


def search_candidates(
    prepared: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    candidates: Sequence[Mapping[str, object]] = BOOST_CANDIDATES,
) -> tuple[Mapping[str, object], DataFrame]:
    """Fit every candidate on train and score it on validation.

    Returns the settings with the lowest median pinball loss (the first wins ties)
    and the table of all validation metrics.
    """
    searches = fit_searches(prepared, targets={"": target}, feature_sets={"": features}, candidates=candidates, refit=False)
    results = _candidate_metrics(prepared, searches, candidates)
    return candidates[_choices(results)["", ""]], results.drop("horizon", "feature_set")


def refit_and_score_test(
    prepared: DataFrame,
    *,
    target: str,
    features: Sequence[str],
    config: Mapping[str, object],
    keep: Sequence[str],
) -> DataFrame:
    """Refit the chosen settings on everything before the test span; predictions for the test."""
    models = fit_candidates(
        before_test(prepared), target=target, features=features, candidates=[config]
    )[0]
    scored = predict_quantiles(prepared.where(F.col("split") == "test"), models)
    return scored.select(
        *keep, target, F.lit(config["name"]).alias("model_name"), *models
    )


def train_horizons(
    df: DataFrame,
    *,
    labels: Sequence[str],
    features: Sequence[str],
    keep: Sequence[str],
    target_prefix: str = "load_target_",
    impute: Sequence[str] = (),
    candidates: Sequence[Mapping[str, object]] = BOOST_CANDIDATES,
) -> DataFrame:
    """Select, refit and score one model per horizon; test predictions of all horizons."""
    predictions, _ = score_horizons(
        df, horizons=dict.fromkeys(labels, 0), features=features, keep=keep,
        target_prefix=target_prefix, impute=impute, candidates=candidates,
    )
    return predictions.where(F.col("split") == "test").drop("split", "lead_steps", "feature_set")


def score_horizons(
    df: DataFrame,
    *,
    horizons: Mapping[str, int],
    features: Sequence[str] | Mapping[str, Sequence[str]],
    keep: Sequence[str],
    target_prefix: str = "load_target_",
    impute: Sequence[str] = (),
    candidates: Sequence[Mapping[str, object]] = BOOST_CANDIDATES,
) -> tuple[DataFrame, DataFrame]:
    """Validation and test predictions of every horizon (label to lead), and the candidate table.

    ``features`` may name several feature sets, such as one with weather; each is searched
    by itself, in the same passes. Validation rows are predicted by the chosen candidate as
    fitted on train only, so intervals can be calibrated on them; test rows by the refit on
    train and validation. Both carry ``split``, ``horizon``, ``lead_steps``, ``feature_set``
    and ``actual_target_mw``, which the calibration and the horizon report take as they are.
    """
    sets = dict(features) if isinstance(features, Mapping) else {"all": list(features)}
    targets = {label: f"{target_prefix}{label}" for label in horizons}
    every = list(dict.fromkeys(f for names in sets.values() for f in names))
    needed = dict.fromkeys([*keep, "split", *every, *targets.values()])
    # The medians take several passes over their rows.
    stored = cut_lineage(df.select(*needed))
    prepared = cut_lineage(drop_incomplete(impute_train_median(stored, impute), every))
    searches = fit_searches(prepared, targets=targets, feature_sets=sets, candidates=candidates)
    results = _candidate_metrics(prepared, searches, candidates)
    chosen, parts = _choices(results), []
    for label, target in targets.items():
        for split in ("validation", "test"):
            models = []
            for search in searches:
                if search.label == label:
                    best = chosen[label, search.feature_set]
                    constants = {
                        "model_name": candidates[best]["name"], "feature_set": search.feature_set,
                        "horizon": label, "lead_steps": horizons[label], "split": split,
                    }
                    models.append((constants, (search.on_train if split == "validation" else search.refitted)[best]))
            rows = prepared.where((F.col("split") == split) & F.col(target).isNotNull())
            parts.append(_scored(rows.select(*keep, *every, F.col(target).alias("actual_target_mw")), models).drop(*[f for f in every if f not in keep]))
    return reduce(DataFrame.unionByName, parts), results
