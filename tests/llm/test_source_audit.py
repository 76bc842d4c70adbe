import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.compare import connect, differences
from tidegrid.llm import source_audit as A
from tidegrid.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string"


def brute(rows, least=A.LEAST_DOCUMENTS, top=A.TOP_TERMS):
    """Every share of every kept term in every group, straight from the definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, holds, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(found)
        holds[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in holds[lang].items() if n >= least), key=str.encode)

        def share(of):
            whole = sum(of[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (of[t] + 5) // whole for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(n, sources=5, seed=3):
    draw = random.Random(seed)
    words = ["the", "The", "éa", "Éa", "x-y", "日本", "b", "c'd", "rare", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    rows = []
    for i in range(n):
        text = " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=draw.randint(0, 60)))
        rows.append((i, text, draw.choice(["en", "de", None]), draw.choice([*(f"s{k}" for k in range(sources)), None])))
    return rows


def test_query_equals_its_sql(spark, sf_dir):
    got = QUERIES["op11_source_audit"](spark, sf_dir).toPandas()
    assert not differences(got, connect(sf_dir).execute(ORACLE_SQL["op11_source_audit"]).df())


@pytest.mark.parametrize("memory, fan_in", [(A.MEMORY, A.FAN_IN), (20_000, 1000), (20_000, 3)])
def test_any_number_of_runs_gives_the_brute_force(spark, memory, fan_in):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert found(A.divergence(docs, least_documents=5, top_terms=7, memory=memory, fan_in=fan_in)) == brute(rows, 5, 7)


def test_a_full_memory_makes_more_runs(spark):
    docs = spark.createDataFrame(corpus(300), SCHEMA).coalesce(2)
    runs = [A.build_runs(docs, 4, memory).where("size(terms) > 0").select("run").distinct().count() for memory in (A.MEMORY, 20_000)]
    assert runs[0] == 2 and runs[1] > 10


def test_runs_are_sorted_and_whole(spark):
    rows = corpus(80)
    for row in A.build_runs(spark.createDataFrame(rows, SCHEMA), 3, 30_000).collect():
        assert row.terms == sorted(row.terms) and sum(row.width) == len(row.source) == len(row.occurrences)


def test_many_sources(spark):
    rows = corpus(400, sources=60)
    assert found(A.divergence(spark.createDataFrame(rows, SCHEMA), least_documents=10)) == brute(rows, 10)


def test_nulls_ties_repeats_long_texts_and_languages_without_terms(spark):
    rows = [(1, "A a B", "en", "x")] * 2 + [(2, None, "en", "y"), (3, "", None, None), (4, "a " * 50_000, "en", "z"), (5, "ß" * 70_000, "en", "z")]
    rows += [(None, "a b \x00c", "en", None), (7, "q", "fr", "x"), (8, "q", "fr", "y")]
    got = found(A.divergence(spark.createDataFrame(rows, SCHEMA), least_documents=2))
    assert got == brute(rows, 2)
    assert ("fr", "x", "pair", "y", 0, 1) in found(A.divergence(spark.createDataFrame(rows, SCHEMA), least_documents=3))


def test_clashing_columns_and_an_empty_table(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3, "n") for r in rows], SCHEMA + ", run int, terms string, rank int, value int, item string")
    assert found(A.divergence(docs, least_documents=3)) == brute(rows, 3)
    assert found(A.divergence(docs.limit(0))) == []


def test_shares_are_exact_beyond_64_bit_products():
    counts, totals = np.array([5, 10**12 + 7, 10**15 // 3], np.int64), np.array([10**15] * 3, np.int64)
    assert A.shares(counts, totals).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(counts, totals)]
