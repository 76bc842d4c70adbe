import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import token_alignment as L
from tidegrid.llm.queries import QUERIES

PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
SYMBOL = L._byte_of_symbol()
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokens(text):
    """Whole texts through both libraries: [(id, start, end)] of each, or nothing."""
    if not text:
        return [], []
    out = []
    a = [(i, bytes(SYMBOL[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes.fromhex(p[3:5]) if B.is_byte(i) else p.replace("▁", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    for some in (a, b):
        if b"".join(t for _, t in some) != (" " + text).encode():
            return [], []
        at, placed = 0, []
        for i, t in some:
            placed.append((i, at, at + len(t)))
            at += len(t)
        out.append(placed)
    return out


def brute(rows):
    aligned = []
    for doc_id, text in rows:
        a, b = tokens(text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) < 400 else quick_links(a, b)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in ends:
            inside = [",".join(str(i) for i, s, e in some if start <= s and e <= end) for some in (a, b)] if len(ends) < 400 else None
            groups.append(inside)
            start = end
        if len(ends) >= 400:
            groups = quick_groups(a, b, ends)
        digest = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if a else ""
        aligned.append((doc_id, len(a), len(b), len(ends), links, digest))
    count = Counter(link for *_, links, _ in aligned for link in links)
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (d, na, nb, ng, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest)
        for d, na, nb, ng, links, digest in aligned
    ]


def quick_links(a, b):
    out, at = [], 0
    for i, s, e in a:
        while b[at][2] <= s:
            at += 1
        k = at
        while k < len(b) and b[k][1] < e:
            out.append((i, b[k][0]))
            k += 1
    return out


def quick_groups(a, b, ends):
    out, x, y = [], 0, 0
    for end in ends:
        parts = []
        for some, at in ((a, x), (b, y)):
            k = at
            while k < len(some) and some[k][2] <= end:
                k += 1
            parts.append((",".join(str(i) for i, *_ in some[at:k]), k))
        (first, x), (second, y) = parts
        out.append([first, second])
    return out


def result(df):
    rank = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=rank)


ODD = [
    "a", " a", "a ", "  a", "a  b", "a\n\nb", "a\n b", "a \n b", "\n", "\n\n", "\n\nb", " ", "  ", "a\n\n b", "a\tb", "\ta", "a;\rb", "a\r\nb", "x\x1c!y !\x1c",
    "don't we'll 'S", "<|endoftext|> <s></s><unk> <0x0A>", "it▁s", "▁", "日本語テキスト 漢字", "héé é", "é ́", "\U0001f600\U0001f468‍\U0001f469 ok",
    " a b ", "　x", "1234567 12,5%", "a" * 3000, "\x00 a\x00", "﻿a", "a b", "a  b", "ab" * 40 + " \n\t q", "\x85a",
]


def test_query_equals_brute_force(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert result(QUERIES["op12_token_alignment"](spark, sf_dir)) == sorted(brute(rows))


@pytest.mark.parametrize("heavy", [L.HEAVY, 40, 1])
def test_odd_texts_nulls_and_repeats_at_any_bound(spark, docs, heavy):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, "  a"), (None, "a"), (None, None), (99, ""), (100, "word " * 30_000)]
    want = sorted(brute(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
    assert result(L.alignment(docs(rows, "codes"), *PATHS, heavy=heavy)) == want
    assert result(L.alignment(docs([], "n_a"), *PATHS, heavy=heavy)) == []


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab' ,1é\n\n \t\r \x1c漢;{")), max_size=25))
def test_pieces_give_both_libraries_ids(text):
    made = L.aligner(*PATHS).links(text)
    a, b = tokens(text)
    assert (made["a_ids"], made["b_ids"]) == ([i for i, *_ in a], [i for i, *_ in b])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=12), st.lists(st.integers(1, 5), max_size=12))
def test_products_equal_dense_ones(a, b):
    short = sum(a) - sum(b)
    a, b = a + [-short] * (short < 0), b + [short] * (short > 0)
    made = L.align(np.array(a, np.int64), np.array(b, np.int64))
    dense = lambda lengths: np.repeat(np.eye(len(lengths), dtype=int), lengths, axis=1)
    product = dense(a) @ dense(b).T if a else np.zeros((0, 0), int)
    rows, columns = np.nonzero(product)
    assert (made.link_a.tolist(), made.link_b.tolist()) == (rows.tolist(), columns.tolist())
    assert made.overlap.tolist() == product[rows, columns].tolist()
    same = [(i, j) for i, g in enumerate(made.group_a) for j, h in enumerate(made.group_b) if g == h]
    assert list(zip(*map(np.ndarray.tolist, made.shared_group_links()))) == same


def test_products_in_small_blocks_are_the_same(monkeypatch):
    draw = np.random.default_rng(1)
    a = L.Csr(np.concatenate([[0], np.cumsum(draw.integers(0, 4, 50))]), np.zeros(0, np.int64), 30)
    a.columns = draw.integers(0, 30, a.starts[-1])
    whole = L.row_products(a, a.transposed())
    monkeypatch.setattr(L, "EXPANSION", 3)
    for one, other in zip(whole, L.row_products(a, a.transposed())):
        assert one.tolist() == other.tolist()


def test_a_forgetful_worker_gives_the_same(monkeypatch):
    texts = ["the cat sat", "", "the dog sat", "a b\tc"] * 3
    whole = L.Aligner(*PATHS).documents(texts)
    monkeypatch.setattr(L, "KEPT_PIECES", 1)
    forgetful = L.Aligner(*PATHS)
    for _ in range(2):
        again = forgetful.documents(texts)
        assert again["groups_sha256"] == whole["groups_sha256"] and again["codes"].to_pylist() == whole["codes"].to_pylist()


def test_links_of_documents(spark, docs):
    row = L.token_links(docs([(1, "unbelievable héé"), (2, None)]), *PATHS).orderBy("doc_id").collect()
    a, b = tokens("unbelievable héé")
    links = [(k, m) for k, (_, s, e) in enumerate(a) for m, (_, t, f) in enumerate(b) if s < f and t < e]
    assert list(zip(row[0].link_a, row[0].link_b)) == links and sum(row[0].overlap) == len(" unbelievable héé".encode())
    assert row[1].a_ids == [] and row[1].link_a == []
