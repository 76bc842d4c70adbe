import zlib

import duckdb
import numpy as np
import pytest

from tidegrid.llm import quality as Q
from tidegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def label_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in QUERIES["op7_quality"](spark, SF).collect()}


def test_fold_and_columns(scored):
    assert len(scored) == 1000
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_held_out_accuracy(scored):
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    right = [scored[i].predicted == y for i, y in labels if scored[i].held_out]
    assert len(right) > 50 and np.mean(right) > 0.93


def test_weights_rank_pairs():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(400, 5))
    label = (x @ [2, -1, 0, 0, 0.5] > -1).astype(int)
    model = Q.fit_model(x, label)
    s = model.scores(x)
    assert s[label == 1].min() > s[label == 0].max() - 0.35
    assert np.mean((s >= Q.BORDER) == label) > 0.97


def test_one_label_only_or_none(spark, docs):
    frame = docs([(1, "a b"), (2, None), (2, None), (None, "x")], "label")
    one = Q.train(frame, label_rows(spark, [(1, 1, 0), (3, 0, 0), (None, 1, 1), (2, None, 0)]), "quality")
    assert {r.score for r in Q.score(frame, one).collect()} == {1.0}
    none = Q.train(frame, label_rows(spark, []), "quality")
    got = Q.score(frame, none).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert Q.score(docs([]), none).count() == 0


def test_measures_of_odd_texts():
    for text in ("", " ", "\n\n", "é" * 100_000, "\x00", "a" * 50_000, "漢字。"):
        assert len(Q.measures(text)) == len(Q.NAMES) and np.isfinite(Q.measures(text)).all()


def test_query_scores_recomputed(spark, scored):
    """Pairs, weights, border, slope and scores from their definitions: by slopes of the plain losses, not by the module's solver."""
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    known = [(y, tuple(Q.measures(texts[i] or ""))) for i, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    known = sorted(known, key=lambda r: (r[0], *reversed(r[1])))
    y, x = np.array([r[0] for r in known]), np.array([r[1] for r in known])
    model = Q.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "quality")

    spread = x.std(axis=0) + 1e-6
    w, z = model.weights * spread, (x - x.mean(axis=0)) / spread
    good, bad, pick = z[y == 1], z[y == 0], np.random.default_rng(17)
    n = 8 * max(len(good), len(bad))
    better, worse = (side[pick.permutation(np.resize(np.arange(len(side)), n))] for side in (good, bad))
    loss = lambda v: np.log1p(np.exp(-((better - worse) @ v))).mean() + 1e-4 / 2 * v @ v
    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-4
        assert abs(loss(w + step) - loss(w - step)) / 2e-4 < 1e-5, Q.NAMES[k]

    worth = z @ w
    place, ordered = (len(y) - 1) * float((y == 0).mean()), sorted(worth)
    low = int(place)
    assert model.border == pytest.approx(ordered[low] + (place - low) * (ordered[low + 1] - ordered[low]), abs=1e-4)
    assert np.mean(worth < model.border) == pytest.approx((y == 0).mean(), abs=1.5 / len(y))
    base = np.log(0.3 / 0.7)

    def fit_loss(s):
        p = 1 / (1 + np.exp(-(base + s * (worth - model.border))))
        return -np.mean(y * np.log(p) + (1 - y) * np.log1p(-p)) + 1e-3 / 2 * s * s

    assert abs(fit_loss(model.slope + 1e-4) - fit_loss(model.slope - 1e-4)) / 2e-4 < 1e-4
    for i, row in scored.items():
        mine = (np.array(Q.measures(texts[i] or "")) - x.mean(axis=0)) / spread @ w
        assert row.score == pytest.approx(1 / (1 + np.exp(-np.clip(base + model.slope * (mine - model.border), -30, 30))), abs=1e-6)
