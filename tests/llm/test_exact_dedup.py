import random

import pytest

from tidegrid.llm import exact_dedup as D


def expected(rows):
    """Brute force: (doc_id, keep_id, group_size, kept) per row."""
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is not None, i or 0))
    made = []
    for g in groups.values():
        for n, x in enumerate(sorted(g)):
            keep = min(g)
            made.append((x[2] if x[1] else None, keep[2] if keep[1] else None, len(g), n == 0))
    return sorted(made, key=str)


def got(frame):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in frame.collect()), key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "b a"), (7, "b a"), (None, "ab "), (8, "é" * 9000), (9, "é " * 9000)]


def test_against_brute_force(docs):
    assert got(D.exact_duplicates(docs(ROWS, "key"))) == expected(ROWS)


def test_fingerprints_compose():
    pick = random.Random(3)
    data = bytes(pick.randrange(256) for _ in range(20_000))
    whole = D.fingerprint(data)
    for cut in (0, 1, 4095, 4096, 12_345):
        assert D.combine(D.fingerprint(data[:cut]), D.fingerprint(data[cut:])) == whole
    assert whole == (int.from_bytes(data, "big") % D.PRIME, len(data))


@pytest.mark.parametrize("lane", [2, 2_000])
def test_collisions_are_told_apart(docs, monkeypatch, lane):
    """With fingerprints that all collide, comparison alone separates the texts."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(D)
    try:
        monkeypatch.setattr(D, "ROWS_A_TASK", lane)
        monkeypatch.setattr(D, "PRIME", 1)
        monkeypatch.setattr(D, "fingerprint", lambda data: (0, 0))
        rows = [(i, "abc"[i % 3] + " " * i) for i in range(12)]
        assert got(D.exact_duplicates(docs(rows))) == expected(rows)
    finally:
        cloudpickle.unregister_pickle_by_value(D)


def test_empty_table(docs):
    assert D.exact_duplicates(docs([])).count() == 0
