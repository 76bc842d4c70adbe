import random
import re
from collections import Counter

import duckdb
import pytest

from tidegrid.llm import decontaminate as D
from tidegrid.llm.queries import QUERIES


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(w, n=5):
    n = min(n, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute(rows, items):
    """Every window of every document against every item of its length; without a common shingle the similarity is 0."""
    found = set()
    known = [(i, words(t), grams(words(t))) for i, t in items]
    for doc, t in rows:
        w = words(t)
        mine = {width: set(grams(w, width)) for width in range(1, 6)}
        for item, iw, ig in known:
            if not iw or mine[min(5, len(iw))].isdisjoint(ig):
                continue
            for s in range(len(w) - len(iw) + 1):
                g = grams(w[s : s + len(iw)])
                if sum((g & ig).values()) >= 0.8 * sum((g | ig).values()) - 1e-9:
                    found.add((doc, item, s, len(iw)))
    return found


def items_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id bigint, text string, size string")


def got(frame):
    rows = [(r.doc_id, r.item_id, r.start, r.n_words) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_on_whole_table(spark, sf_dir, documents):
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    assert got(QUERIES["op4_decontamination"](spark, sf_dir)) == brute(documents.items(), items)


@pytest.mark.parametrize("rows", [0, 500_000])
def test_near_copies_against_brute_force(spark, docs, monkeypatch, rows):
    """Edited passages, with the items' shingles broadcast and shuffled."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", rows)
    pick = random.Random(9)
    make = lambda n: [f"w{pick.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(make(n))) for k, n in enumerate((3, 8, 30, 30, 60, 90))]
    rows = []
    for k in range(60):
        body = make(50)
        passage = words(pick.choice(items)[1])
        for _ in range(pick.choice((0, 0, 1))):
            passage[pick.choice((0, 1, -1, -2, len(passage) // 2))] = "changed"
        rows.append((k, " ".join(body[:20] + passage + body[20:])))
    want = brute(rows, items)
    assert len(want) > 20
    assert got(D.contamination(docs(rows, "w"), items_frame(spark, items))) == want


def test_blocks_find_every_pair_within_the_radius(spark):
    pick = random.Random(1)
    pairs = []
    for _ in range(300):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), pick.randrange(D.RADIUS + 1)):
            b ^= 1 << bit
        pairs.append((a - (1 << 63), b - (1 << 63)))
    frame = spark.createDataFrame(pairs, "a bigint, b bigint")
    keys = frame.select(D.block_keys(frame.a).alias("ka"), D.block_keys(frame.b).alias("kb"))
    assert keys.where("NOT arrays_overlap(ka, kb)").count() == 0


def test_nulls_short_texts_and_empty_tables(spark, docs):
    items = items_frame(spark, [(1, None), (2, ""), (3, "one two"), (None, "alpha beta gamma delta epsilon zeta")])
    rows = [(1, None), (2, "zero One, TWO!"), (None, "alpha beta gamma delta epsilon zeta"), (2, "zero One, TWO!"), (3, "two")]
    found = sorted(map(str, got(D.contamination(docs(rows), items))))
    assert found == ["(2, 3, 1, 2)", "(None, None, 0, 6)"]
    assert D.contamination(docs([]), items).count() == 0
    assert D.contamination(docs(rows), items.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    QUERIES["op4_decontamination"](spark, sf_dir).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


@pytest.mark.parametrize("limit", [0, 500_000])
def test_documents_shorter_than_an_item(spark, docs, monkeypatch, limit):
    """A near copy with words left out, as the whole document."""
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)
    pick = random.Random(4)
    items = [(k, " ".join(f"w{pick.randrange(300)}" for _ in range(n))) for k, n in enumerate((50, 50, 90))]
    rows = []
    for k in range(40):
        w = words(pick.choice(items)[1])
        for _ in range(pick.choice((1, 1, 2))):
            del w[pick.choice((0, -1, 3, len(w) // 2))]
        rows.append((k, " ".join(w[: pick.choice((len(w), len(w), 44, 4))])))
    want = set()
    for doc, t in rows:
        for item, it in items:
            a, b = grams(words(t)), grams(words(it))
            if len(words(t)) >= 5 and sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9:
                want.add((doc, item, 0, len(words(t))))
    assert len(want) > 15 and got(D.contamination(docs(rows), items_frame(spark, items))) == want
