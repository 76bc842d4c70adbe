import random

import numpy as np
import pytest

from tidegrid.llm import components as C
from tidegrid.llm import ngram_join as J
from tidegrid.llm.queries import QUERIES


def grams(text, n=5):
    words = J.words_of(text or "")
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def expected(rows):
    """doc_id -> (class_id, class_size, n_links, group_id) by comparing all pairs of classes."""
    sets = {}
    for i, text in rows:
        sets.setdefault(grams(text), []).append(i)
    keys = sorted(sets, key=lambda s: min(sets[s]))
    ids, links, root = [min(sets[k]) for k in keys], [0] * len(keys), list(range(len(keys)))
    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if both and both >= 0.8 * len(keys[a] | keys[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return {i: (ids[k], len(sets[s]), links[k], ids[root[k]]) for k, s in enumerate(keys) for i in sets[s]}


def got(frame):
    return {r.doc_id: (r.class_id, r.class_size, r.n_links, r.group_id) for r in frame.collect()}


def variants(seed, bases=6, each=14):
    pick, rows = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{pick.randrange(999)}" for _ in range(pick.choice((3, 60, 120)))]
        for _ in range(each):
            words = list(base)
            for _ in range(pick.choice((0, 0, 1, 1, 2))):
                words[pick.randrange(len(words))] = f"v{pick.randrange(99)}"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("block,grams", [(4, 1 << 19), (512, 1 << 19), (512, 20)])
def test_against_all_pairs(docs, monkeypatch, block, grams):
    """Also with far more blocks than classes, so that some are empty."""
    monkeypatch.setattr(J, "BLOCK_CLASSES", block)
    monkeypatch.setattr(J, "BLOCK_GRAMS", grams)
    rows = variants(3)
    assert got(J.jaccard_links(docs(rows, "group"), recall=0.999999)) == expected(rows)


def test_query_on_whole_table(spark, sf_dir, documents):
    assert got(QUERIES["op9_ngram_join"](spark, sf_dir)) == expected(sorted(documents.items()))


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**J.ROWS) ** J.band_count() >= J.RECALL > 1 - (1 - 0.8**J.ROWS) ** (J.band_count() - 1)


def test_overlaps_against_sets():
    pick = np.random.default_rng(4)
    left, right = ([np.unique(pick.integers(0, 400, 90).astype(np.uint64)) for _ in range(k)] for k in (15, 22))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert J._overlaps(left, right).tolist() == want


def test_nulls_short_texts_repeats_and_empty_table(docs):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, text), (5, text), (None, text), (6, "!!")]
    made = J.jaccard_links(docs(rows, "bands")).collect()
    assert len(made) == 8
    assert sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in made) == [
        (0, 0, 3), (1, 1, 3), (2, 1, 3), (3, 3, 2), (4, 3, 2), (5, 0, 3), (5, 0, 3), (6, 1, 3),
    ]
    assert J.jaccard_links(docs([])).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.root for r in C.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
