import hashlib
import math
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import pytest

from tests.compare import connect, differences
from tidegrid.llm import source_mixing as M
from tidegrid.llm.queries import ORACLE_SQL, QUERIES


def brute_targets(sizes, shares=M.SHARES, most=M.MOST_REPEATS):
    """The stated rule itself: reshare the excess by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), Fraction(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: rest * weight[s] / total for s in free}
        for s in over:
            target[s] = Fraction(most * sizes[s])
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def brute(rows, weight=lambda i: 1.0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    groups = defaultdict(list)
    for at, (i, _, source) in enumerate(rows):
        u = (int(hashlib.md5(f"{M.SEED}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = weight(i)
        groups[source].append((-math.log(u) / w if w > 0 else math.inf, i if i is not None else -(2**63), size[at], at))
    targets = brute_targets({s: sum(m[2] for m in g) for s, g in groups.items()})
    out = []
    for source, members in groups.items():
        whole = sum(m[2] for m in members)
        epochs = min(M.MOST_REPEATS, int(targets[source] // whole)) if whole else 0
        rest = 0 if epochs == M.MOST_REPEATS else math.floor(targets[source] + Fraction(1, 2)) - epochs * whole
        for _, _, n, at in sorted(members):
            out.append((rows[at][0], n, whole, float(targets[source]), epochs * n + min(n, rest)))
            rest -= min(n, rest)
    return out


def taken(df):
    return [(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in df.collect()]


def close(got, want):
    rank = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert len(got) == len(want)
    for g, w in zip(rank(got), rank(want)):
        assert g[:3] == w[:3] and g[4] == w[4] and g[3] == pytest.approx(w[3], rel=1e-12)


SCHEMA = "doc_id bigint, text string, source string"


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{sf_dir}/documents.parquet'").fetchall()
    label = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{sf_dir}/labels.parquet' WHERE quality IN (0, 1) GROUP BY 1").fetchall())
    want = brute(rows, lambda i: M.LABEL_WEIGHTS[label[i]] if i in label else M.UNLABELLED_WEIGHT)
    close(taken(QUERIES["op13_source_mixing"](spark, sf_dir)), want)


def test_query_equals_its_sql(spark, sf_dir):
    got = QUERIES["op13_source_mixing"](spark, sf_dir).toPandas()
    assert not differences(got, connect(sf_dir).execute(ORACLE_SQL["op13_source_mixing"]).df())


def test_nulls_ties_repeats_and_empty_texts(spark):
    rows = [
        (1, "a b c", "x"), (1, "a b c", "x"), (None, "a  b", "x"), (None, None, None), (5, "z", None),
        (6, "", "empty"), (7, None, "empty"), (8, "w " * 5000, "long"), (9, "\x0b\x1f é\x00q", "y"), (10, "one", ""),
    ]
    close(taken(M.mix(spark.createDataFrame(rows, SCHEMA))), brute(rows))


def test_a_source_in_many_parts(spark):
    rows = [(i, "w " * (i % 17), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        close(taken(M.mix(spark.createDataFrame(rows, SCHEMA))), brute(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_targets_stop_at_three_times_the_size():
    assert brute_targets({"a": 1, "b": 100, "c": 100}) == {"a": 3, "b": 132, "c": 66}


def test_words_meet_the_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 7}" if i % 2 else "big") for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    first, again = taken(M.mix(df)), taken(M.mix(df.repartition(7)))
    assert sorted(first) == sorted(again)
    assert all(t <= 3 * n for _, n, _, _, t in first)
    words = defaultdict(int)
    for _, _, whole, target, t in first:
        words[whole, target] += t
    assert all(abs(total - target) <= 0.5 for (_, target), total in words.items())


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10, "a") for i in range(2000)] + [(5000 + i, "w", f"b{i}") for i in range(3)]
    weights = spark.createDataFrame([(i, 8.0 if i % 2 else 1.0) for i in range(2000)], "doc_id bigint, weight double")
    plan = M.mix(spark.createDataFrame(rows, SCHEMA), weights, shares=(1, 1, 1, 1), most_repeats=10**5)
    drawn = [r for r in plan.where("source = 'a'").collect() if r.taken > 0]
    assert 0.2 < len(drawn) / 2000 < 0.3
    assert sum(r.doc_id % 2 for r in drawn) / len(drawn) > 0.7


def test_worthless_documents_come_last(spark):
    rows = [(i, "w", "a") for i in range(10)] + [(99, "w " * 5, "b")]
    weights = spark.createDataFrame([(i, 0.0 if i < 5 else None) for i in range(10)], "doc_id bigint, weight double")
    plan = {r.doc_id: r.taken for r in M.mix(spark.createDataFrame(rows, SCHEMA), weights, shares=(1, 2)).collect()}
    assert [plan[i] for i in range(5)] == [0] * 5 and [plan[i] for i in range(5, 10)] == [1] * 5


def test_clashing_columns_and_an_empty_table(spark):
    wide = "doc_id bigint, text string, source string, size int, target string, taken int, weight int, _s int, _key int, _part int"
    df = spark.createDataFrame([(1, "a b", "x", 9, "t", 9, 9, 9, 9, 9)], wide)
    assert [(r.size, r.taken) for r in M.mix(df).collect()] == [(2, 2)]
    assert M.mix(df.limit(0)).collect() == []
    none = spark.createDataFrame([], "doc_id bigint, weight double")
    assert M.mix(df, none).first().taken == 2


def test_the_mix_holds_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(1 + i % 9)), f"s{i % 4}") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = M.mix(docs)
    words = defaultdict(int)
    for r in M.mixed_texts(docs, plan).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.copy <= 3 and dict((i, t) for i, t, _ in rows)[r.doc_id].startswith(r.text)
    assert words == {r.doc_id: r.taken for r in plan.collect() if r.taken}
