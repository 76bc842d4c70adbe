"""Toxicity by maximum-scoring segments over token log-odds.

Training counts tokens (words, and the beginnings of longer words) in labelled toxic and clean
texts. Log-odds use an informative Dirichlet prior, the token's frequency over *all* documents,
and are lowered by a multiple of their standard deviation; what stays significantly above zero
is the lexicon. Other words get a small negative score, the log of the share of ordinary words
in a toxic passage.

A linear scan (of Ruzzo and Tompa's kind) over a text's token scores yields every maximal
segment with a positive total. By extreme-value theory the best total of ``n`` ordinary tokens
follows a Gumbel law, ``P(S >= s) ~ 1 - exp(-K n exp(-lambda s))``; lambda solves
``sum(p exp(lambda s)) = 1`` over ordinary text. Totals are normalised to ``lambda S - ln n``, and
those of a text's segments are joined by Karlin and Altschul's sum statistic. A logistic curve fitted on the labelled texts (it absorbs K) turns the statistic into a score.

The fit uses at most ``sample`` labelled rows, those with the smallest hash of their id, so the
lexicon is bounded; the prior's counts and the scores cover every document. What is counted in
labelled texts is the different contexts (neighbouring words) of a token, so a passage that many
labelled texts copy counts once. Likewise a word scores once per context in a text's statistic;
the passages are those of a scan over all words, copies included.

Nulls count as empty text; texts without words get the score of no evidence. Labels that are
null or whose document is missing are ignored. Without rows of both labels every score is the
share of ones (0.5 if there is no label at all).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.quality import held_out
from tidegrid.llm.storage import map_texts, stored, text_or_empty

SAMPLE = 30_000
BORDER = 0.5
BEGINNINGS = (4, 5, 6, 7)
LEAST_TEXTS = 3
PRIOR_SHARE = 0.1
SIGNIFICANT = 4.0
LEAST_SCORE = 1.0
DENSITY = 0.1
_WORD = re.compile(r"\w+")
_KEPT = 300_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def tokens_of(word: str) -> list[str]:
    """The word and its beginnings, marked."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, total) of a sequence.

    ``scores`` has the positions with a positive score; each position between costs ``drift``.
    A stack holds (first, last, total before, total after); each entry is looked at a bounded
    number of times on average.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for position, value in scores:
        total += drift * (position - at)
        entry = (position, position, total, total + value)
        total, at = total + value, position + 1
        while True:
            below = len(stack) - 1
            while below >= 0 and stack[below][2] >= entry[2]:
                below -= 1
            if below < 0 or stack[below][3] >= entry[3]:
                break
            entry = (stack[below][0], entry[1], stack[below][2], entry[3])
            del stack[below:]
        stack.append(entry)
    return [(first, last, after - before) for first, last, before, after in stack]


class _WordScores(dict):
    def __init__(self, lexicon: dict[str, float]):
        self._lexicon = lexicon

    def __missing__(self, word: str) -> float:
        found = max((self._lexicon.get(t, 0.0) for t in tokens_of(word)), default=0.0)
        if len(self) < _KEPT:
            self[word] = found
        return found


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    drift: float
    rate: float  # lambda
    offset: float = 0.0
    slope: float = 1.0
    constant: float | None = None

    def _hits(self, text: str, scores: _WordScores) -> tuple[list[str], list[tuple[int, float]]]:
        words = words_of(text)
        return words, [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s]

    def _normalised(self, hits: list[tuple[int, float]], n: int) -> list[tuple[int, int, float]]:
        return [(a, b, self.rate * s - math.log(n)) for a, b, s in segments(hits, self.drift)]

    def passages(self, text: str, scores: _WordScores) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and all maximal segments with normalised totals."""
        words, hits = self._hits(text, scores)
        n = max(1, len(words))
        return n, self._normalised(hits, n)

    def statistic(self, text: str, scores: _WordScores) -> float:
        """Minus the logarithm of the sum statistic's probability, for the number of segments that makes it largest."""
        return self._statistic(*self._hits(text, scores))

    def _statistic(self, words: list[str], hits: list[tuple[int, float]]) -> float:
        """Copies of a passage add no evidence: of hits in the same context the first counts."""
        first = {tuple(words[max(0, i - 1) : i + 2]): (i, s) for i, s in reversed(hits)}
        n = max(1, len(words))
        found = self._normalised(sorted(first.values()), n)
        best, total = -math.log(n) - 1, 0.0
        for r, value in enumerate(sorted((s for _, _, s in found), reverse=True), 1):
            total += value
            if total <= 0:
                return max(best, total) if r == 1 else best
            best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r))
        return min(60.0, best)

    def probability(self, statistic: float) -> float:
        if self.constant is not None:
            return self.constant
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * statistic))))


def log_odds(toxic: float, clean: float, prior: float, n_toxic: float, n_clean: float, n_prior: float) -> tuple[float, float]:
    """Difference of log-odds under a Dirichlet prior, and its standard deviation."""
    a, b = toxic + prior, clean + prior
    difference = math.log(a / (n_toxic + n_prior - a)) - math.log(b / (n_clean + n_prior - b))
    return difference, math.sqrt(1 / a + 1 / b)


def solve_rate(background: list[tuple[float, float]]) -> float:
    """The positive root of sum(p exp(rate s)) = 1 for (p, s) with a negative mean; by bisection."""
    total = lambda r: math.fsum(p * math.exp(min(600.0, r * s)) for p, s in background) - 1
    high = 1e-3
    while total(high) < 0 and high < 50:
        high *= 2
    low = 0.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 0 else (low, middle)
    return low


def corpus_counts(docs: DataFrame, tokens: set[str]) -> tuple[dict[str, int], int]:
    """Occurrences of the tokens, and of all words, over every document; counted per batch, then summed."""

    def rows(columns):
        counts, total = Counter(), 0
        for text in columns["text"]:
            words = Counter(words_of(text))
            total += words.total()
            for word, n in words.items():
                for token in tokens_of(word):
                    if token in tokens:
                        counts[token] += n
        counts[""] = total
        return {"token": list(counts), "n": list(counts.values())}

    counted = map_texts(docs, [text_or_empty(docs).alias("text")], "token string, n bigint", rows)
    found = {r.token: r.n for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop("", 0)


def _sample(docs: DataFrame, labels: DataFrame, label_column: str, sample: int) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label_column).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(~held_out(F.col("labelled_id"))).orderBy(F.xxhash64("labelled_id"), "labelled_id", "label").limit(sample)
    texts = docs.select("doc_id", text_or_empty(docs).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id"))
    return texts.select("text", "label").dropDuplicates()


def _likely_tokens(known: DataFrame) -> tuple[set[str], int, int]:
    """Tokens of several toxic texts that are twice as frequent there as in clean texts, and the words of either label."""

    def rows(columns):
        counts = Counter()
        for text, label in zip(columns["text"], columns["label"], strict=True):
            words = Counter(words_of(text))
            counts["", label, "n"] += words.total()
            counts["", label, "texts"] += 1
            of_text = Counter()
            for word, n in words.items():
                for token in tokens_of(word):
                    of_text[token] += n
            for token, n in of_text.items():
                counts[token, label, "n"] += n
                counts[token, label, "texts"] += 1
        keys = list(dict.fromkeys((t, x) for t, x, _ in counts))
        values = {c: [counts[t, x, c] for t, x in keys] for c in ("n", "texts")}
        return {"token": [t for t, _ in keys], "label": [x for _, x in keys]} | values

    counted = map_texts(known, [F.col("text"), F.col("label")], "token string, label int, n bigint, texts bigint", rows)
    of = lambda x, c: F.sum(F.when(F.col("label") == x, F.col(c)).otherwise(0))
    table = counted.groupBy("token").agg(of(1, "n").alias("toxic"), of(0, "n").alias("clean"), of(1, "texts").alias("texts"))
    table = stored(table, "toxicity-counts")
    totals = table.where("token = ''").first()
    n_toxic, n_clean = (totals.toxic, totals.clean) if totals else (0, 0)
    chosen = table.where(f"token <> '' AND texts >= {LEAST_TEXTS} AND toxic * {n_clean}D > 2 * clean * {n_toxic}D")
    return {r.token for r in chosen.select("token").collect()}, n_toxic, n_clean


def _contexts(known: DataFrame, tokens: set[str]) -> dict[str, tuple[int, int]]:
    """Different contexts of each token in toxic and in clean texts."""

    def rows(columns):
        seen = set()
        for text, label in zip(columns["text"], columns["label"], strict=True):
            words = ["", *words_of(text), ""]
            for i in range(1, len(words) - 1):
                for token in tokens_of(words[i]):
                    if token in tokens:
                        seen.add((token, label, f"{words[i - 1]} {words[i]} {words[i + 1]}"))
        return dict(zip(("token", "label", "context"), map(list, zip(*seen, strict=True)), strict=True)) if seen else {"token": [], "label": [], "context": []}

    found = map_texts(known, [F.col("text"), F.col("label")], "token string, label int, context string", rows).distinct()
    of = lambda x: F.sum((F.col("label") == x).cast("int"))
    return {r.token: (r.toxic, r.clean) for r in found.groupBy("token").agg(of(1).alias("toxic"), of(0).alias("clean")).collect()}


def train(docs: DataFrame, labels: DataFrame, label_column: str, *, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold; prior counts from all documents."""
    known = stored(_sample(docs, labels, label_column, sample), "toxicity-sample")
    tokens, n_toxic, n_clean = _likely_tokens(known)
    shares = [r.label for r in known.select("label").collect()]
    if len(set(shares)) < 2 or not n_toxic or not n_clean:
        return ToxicityModel({}, math.log(1 - DENSITY), 1.0, constant=float(np.mean(shares)) if shares else 0.5)
    everywhere, words = corpus_counts(docs, tokens)
    n_prior = PRIOR_SHARE * (n_toxic + n_clean)
    lexicon, background = {}, []
    for token, (toxic, clean) in sorted(_contexts(known, tokens).items()):
        prior = n_prior * max(1, everywhere.get(token, 0)) / max(1, words)
        difference, deviation = log_odds(toxic, clean, prior, n_toxic, n_clean, n_prior)
        if difference > SIGNIFICANT * deviation and difference - deviation > LEAST_SCORE:
            lexicon[token] = difference - deviation
            background.append(((clean + 0.5) / n_clean, lexicon[token]))
    drift = math.log(1 - DENSITY)
    background.append((max(0.5, 1 - math.fsum(p for p, _ in background)), drift))
    return _calibrated(ToxicityModel(lexicon, drift, solve_rate(background)), known)


def _calibrated(model: ToxicityModel, known: DataFrame) -> ToxicityModel:
    """A logistic curve through the statistics of the labelled texts."""

    def rows(columns):
        scores = _WordScores(model.lexicon)
        return {"x": [model.statistic(t, scores) for t in columns["text"]], "label": columns["label"]}

    found = sorted(map(tuple, map_texts(known, [F.col("text"), F.col("label")], "x double, label int", rows).collect()))
    x, y = np.array([v for v, _ in found]), np.array([v for _, v in found], float)
    design, w, ridge = np.column_stack([np.ones_like(x), x / 10]), np.zeros(2), 1e-4
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design / len(x) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) / len(x) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(model.lexicon, model.drift, model.rate, float(w[0]), float(w[1] / 10))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from ``BORDER`` on), and ``passages``: first and last word of each significant segment."""

    def rows(columns):
        scores, made = _WordScores(model.lexicon), {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": [], "passages": []}
        for text in columns["text"]:
            words, hits = model._hits(text, scores)
            made["score"].append(model.probability(model._statistic(words, hits)))
            made["passages"].append(",".join(f"{a}:{b}" for a, b, s in model._normalised(hits, max(1, len(words))) if s > 0))
        return made | {"predicted": [int(s >= BORDER) for s in made["score"]]}

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty(docs).alias("text")]
    return map_texts(docs, columns, "doc_id bigint, held_out boolean, score double, predicted int, passages string", rows)
