"""Quality scores by Bradley-Terry pairwise ranking.

A document is a vector of measures of its whole text: shares of character classes, word and
line shapes, and repetition. Labelled rows give preference pairs: a row labelled 1 is preferred
to a row labelled 0. Weights minimise the logistic loss on feature differences of the pairs, so
a document's worth is a weighted sum and only differences of worth matter. The decision border
is a quantile of the worths of the labelled rows: the share of rows labelled 0. A logistic curve
through that border, with its slope fitted on the same rows, turns worths into scores.

The fit uses at most ``sample`` labelled rows, those with the smallest hash of their id; all
else covers every row. The model is a few dozen numbers.

Nulls count as empty text; empty texts get a score like any other. Labels that are null or
whose document is missing are ignored, repeated rows count as often as they occur. Without rows
of both labels every score is the share of ones (0.5 if there is no label at all).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import keep_rows, map_texts, text_or_empty

SAMPLE = 20_000
PAIRS_A_ROW = 8
BORDER = 0.3
#: Byte classes by their first bytes; what is left of ASCII is "symbols".
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" ",
    "break": b"\n\r\t",
    "stops": b".,;:?",
    "shout": b"!",
    "quote": b"'\"()-",
    "link": b"/@_=&",
    "table": b"|<>{}[]\\",
}
_SYMBOLS = bytes(b for b in range(33, 127) if not any(b in c for c in _CLASSES.values()))
_SETS = [np.frombuffer(c, np.uint8) for c in (*_CLASSES.values(), _SYMBOLS)]
NAMES = (
    *_CLASSES, "symbols", "controls", "wide", "characters", "word_length", "distinct_words", "distinct_pairs", "short_words",
    "capital_words", "bare_words", "line_length", "distinct_lines", "stopped_lines", "longest_word",
)


def measures(text: str) -> list[float]:
    """The features of a text, one per name in ``NAMES``; each is bounded or a logarithm."""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    total = max(1, int(data.sum()))
    shares = [float(np.sqrt(data[s].sum() / total)) for s in _SETS]
    shares += [float(np.sqrt(x / total)) for x in (data[:9].sum() + data[14:32].sum() + data[127], data[128:].sum())]
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        *shares,
        float(np.log1p(total)),
        len("".join(words)) / n / 10,
        len(set(words)) / n**0.9,
        len(pairs) / max(1, len(words) - 1),
        sum(len(w) < 4 for w in words) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        float(np.log1p(total / m)) / 5,
        len(set(lines)) / m,
        sum(x[-1] in ".!?:\"'" for x in lines) / m,
        float(np.log1p(max(map(len, words), default=0))),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Worth is ``(measures - centre) @ weights``; ``border`` is the worth whose score is ``BORDER``."""

    centre: np.ndarray
    weights: np.ndarray
    border: float
    slope: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.log(BORDER / (1 - BORDER)) + self.slope * ((x - self.centre) @ self.weights - self.border)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, ridge: float, rounds: int = 40) -> np.ndarray:
    """Weights of least logistic loss where every row of ``x`` should be positive."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -30, 30)))
        gradient = x.T @ p / len(x) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit_model(x: np.ndarray, label: np.ndarray, pairs_a_row: int = PAIRS_A_ROW, ridge: float = 1e-4) -> QualityModel:
    """Bradley-Terry weights from pairs of a preferred and another row; each row of the rarer label takes part equally often."""
    width = x.shape[1] if x.ndim == 2 else len(NAMES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(width), np.zeros(width), 0.0, 1.0, float(np.mean(label)) if len(label) else 0.5)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / spread
    n = pairs_a_row * max(len(good), len(bad))
    pick = np.random.default_rng(17)
    w = _logistic(z[pick.permutation(np.resize(good, n))] - z[pick.permutation(np.resize(bad, n))], ridge)
    worth = z @ w
    border = float(np.quantile(worth, len(bad) / len(label)))
    slope, base = 1.0, np.log(BORDER / (1 - BORDER))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(base + slope * (worth - border), -30, 30)))
        d = worth - border
        step = (d @ (label - p) / len(d) - 1e-3 * slope) / (d**2 @ (p * (1 - p)) / len(d) + 1e-3)
        slope = float(np.clip(slope + np.clip(step, -1, 1), 0.05, 50))
    return QualityModel(centre, w / spread, border, slope)


def train(docs: DataFrame, labels: DataFrame, label_column: str, *, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("labelled_id"), F.col(label_column).cast("int").alias("label")).where("label IN (0, 1)")
    known = known.where(~held_out(F.col("labelled_id"))).orderBy(F.xxhash64("labelled_id"), "labelled_id", "label").limit(sample)
    texts = docs.select("doc_id", text_or_empty(docs).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id"))

    def rows(columns):
        return {"label": columns["label"], "x": [measures(t) for t in columns["text"]]}

    found = map_texts(texts, [F.col("label"), F.col("text")], "label int, x array<double>", rows).toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(NAMES))
    order = np.lexsort((*x.T, found["label"].to_numpy())) if len(found) else slice(None)
    return fit_model(x[order], found["label"].to_numpy()[order])


def held_out(doc_id: F.Column) -> F.Column:
    """The fold that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from ``BORDER`` on)."""

    def rows(columns):
        values = model.scores(np.array([measures(t) for t in columns["text"]]))
        return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": values.tolist(), "predicted": (values >= BORDER).astype(int).tolist()}

    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty(docs).alias("text")]
    return map_texts(docs, columns, "doc_id bigint, held_out boolean, score double, predicted int", rows)


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model predicts as 1."""
    return keep_rows(docs, lambda texts: (model.scores(np.array([measures(t) for t in texts])) >= BORDER).tolist())
