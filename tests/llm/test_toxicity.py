import math
import random

import duckdb
import numpy as np
import pytest

from tidegrid.llm import toxicity as X
from tidegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_segments(values):
    """Maximal scoring segments by their recursive definition."""
    best, where = 0.0, None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > best + 1e-12:
                best, where = total, (i, j)
    if where is None:
        return []
    i, j = where
    left = [(a, b, s) for a, b, s in brute_segments(values[:i])]
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(values[j + 1 :])]
    return [*left, (i, j, best), *right]


def test_segments_against_definition():
    pick = random.Random(2)
    for _ in range(400):
        values = [pick.choice([-0.37] * 4 + [pick.uniform(0.1, 2)]) for _ in range(pick.randrange(25))]
        got = X.segments([(i, v) for i, v in enumerate(values) if v > 0], -0.37)
        want = brute_segments(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_rate_solves_its_equation():
    background = [(0.99, -0.1), (0.01, 3.0)]
    rate = X.solve_rate(background)
    assert rate > 0 and math.isclose(sum(p * math.exp(rate * s) for p, s in background), 1, rel_tol=1e-6)


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, SF).collect()}


def test_held_out_accuracy(scored):
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall()
    right = [scored[i].predicted == y for i, y in labels if scored[i].held_out]
    assert len(scored) == 1000 and len(right) > 50 and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())


def test_passages_are_found_in_long_texts():
    model = X.ToxicityModel({"vile": 4.0, "nast~": 3.0}, -0.1, 2.0, -2.0, 0.6)
    scores = X._WordScores(model.lexicon)
    text = "plain words " * 400 + "you vile nasty nastier thing " + "plain words " * 400
    n, found = model.passages(text, scores)
    assert n == 1605 and [(a, b) for a, b, _ in found] == [(801, 803)]
    assert model.probability(model.statistic(text, scores)) > 0.5 > model.probability(model.statistic("plain words", scores))


def test_one_label_only_or_none(spark, docs):
    frame = docs([(1, "a b"), (2, None), (2, None), (None, "x")], "label")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in X.score(frame, X.train(frame, labels, "toxic")).collect()} == {1.0}
    none = X.train(frame, labels.limit(0), "toxic")
    got = X.score(frame, none).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert X.score(docs([]), none).count() == 0


def test_repeated_passages_are_all_found():
    model = X.ToxicityModel({"vile": 4.0, "nast~": 3.0}, -0.1, 2.0, -2.0, 0.6)
    scores, line = X._WordScores(model.lexicon), "you vile nasty nastier thing "
    once, twice = "plain words " * 400 + line, ("plain words " * 400 + line) * 2
    assert [(a, b) for a, b, _ in model.passages(twice, scores)[1]] == [(801, 803), (1606, 1608)]
    assert model.statistic(twice, scores) < model.statistic(once, scores)


def test_repeated_passages_are_in_the_table(docs):
    model = X.ToxicityModel({"vile": 4.0, "nast~": 3.0}, -0.1, 2.0, -2.0, 0.6)
    text = ("plain words " * 400 + "you vile nasty nastier thing ") * 2
    assert [r.passages for r in X.score(docs([(1, text)]), model).collect()] == ["801:803,1606:1608"]


def plain_scores(texts, labels):
    """The score of every text from its definition, with plain loops; ``texts`` and ``labels`` by id."""
    import re
    import zlib
    from collections import Counter

    words_of = lambda t: re.findall(r"\w+", (t or "").lower())
    tokens_of = lambda w: [w] + [w[:n] + "~" for n in (4, 5, 6, 7) if len(w) > n]
    known = {(texts[i] or "", y) for i, y in labels if y in (0, 1) and i in texts and zlib.crc32(str(i).encode()) % 5}
    count, held, size = {0: Counter(), 1: Counter()}, Counter(), Counter()
    contexts = {0: Counter(), 1: Counter()}
    seen = set()
    for text, y in known:
        words = words_of(text)
        size[y] += len(words)
        count[y].update(t for w in words for t in tokens_of(w))
        if y == 1:
            held.update({t for w in words for t in tokens_of(w)})
        around = ["", *words, ""]
        seen |= {(t, y, tuple(around[k : k + 3])) for k, w in enumerate(words) for t in tokens_of(w)}
    for t, y, _ in seen:
        contexts[y][t] += 1
    everywhere, total = Counter(), 0
    for text in texts.values():
        words = words_of(text)
        total += len(words)
        everywhere.update(t for w in words for t in tokens_of(w))
    prior_size, lexicon, background = 0.1 * (size[0] + size[1]), {}, []
    for t, n in held.items():
        if n >= 3 and count[1][t] * size[0] > 2 * count[0][t] * size[1]:
            prior = prior_size * max(1, everywhere[t]) / total
            a, b = contexts[1][t] + prior, contexts[0][t] + prior
            odds = math.log(a / (size[1] + prior_size - a)) - math.log(b / (size[0] + prior_size - b))
            spread = (1 / a + 1 / b) ** 0.5
            if odds > 4 * spread and odds - spread > 1:
                lexicon[t] = odds - spread
                background.append(((contexts[0][t] + 0.5) / size[0], odds - spread))
    drift = math.log(0.9)
    background.append((max(0.5, 1 - sum(p for p, _ in background)), drift))
    low, high = 0.0, 50.0
    while high - low > 1e-13:
        middle = (low + high) / 2
        low, high = (middle, high) if sum(p * math.exp(min(600, middle * s)) for p, s in background) < 1 else (low, middle)
    rate = low

    def statistic(text):
        words, met, values = words_of(text), set(), []
        for k, w in enumerate(words):
            value, around = max(lexicon.get(t, 0.0) for t in tokens_of(w)), tuple(words[max(0, k - 1) : k + 2])
            values.append(value if value and around not in met else drift)
            met |= {around} if value else set()
        n = max(1, len(words))
        # Between hits the drift only adds up, so brute force looks at places around them.
        totals = sorted((rate * s - math.log(n) for *_, s in brute_segments(values)), reverse=True)
        best, added = -math.log(n) - 1, 0.0
        for r, value in enumerate(totals, 1):
            added += value
            if added <= 0:
                return max(best, added) if r == 1 else best
            best = max(best, added - (r - 1) * math.log(added) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)))
        return min(60.0, best)

    x, y = np.array([statistic(t) for t, _ in known]) / 10, np.array([y for _, y in known], float)
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        g = np.array([(y - p).mean(), ((y - p) * x).mean()]) - 1e-4 * w
        q = p * (1 - p)
        w = w + np.linalg.solve(np.array([[q.mean(), (q * x).mean()], [(q * x).mean(), (q * x * x).mean()]]) + 1e-4 * np.eye(2), g)
    logistic = lambda s: 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * s / 10))))
    return {i: logistic(statistic(t)) for i, t in texts.items()}


@pytest.mark.parametrize("longest", [None, 250])
def test_scores_equal_plain_ones(spark, sf_dir, longest):
    """The query on a small table, and the operator on the shorter texts of a larger one: plain segments take a square of the length."""
    folder = sf_dir if longest is None else SF
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall()
    if longest is None:
        got = QUERIES["op8_toxicity"](spark, folder)
    else:
        texts = {i: t for i, t in texts.items() if len((t or "").split()) <= longest}
        docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        got = X.score(docs, X.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), "toxic"))
    want, found = plain_scores(texts, labels), {r.doc_id: r.score for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(math.isclose(found[i], want[i], rel_tol=1e-5, abs_tol=1e-7) for i in want)
    assert longest is None or max(want.values()) > 0.5 > min(want.values())
