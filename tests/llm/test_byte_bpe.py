import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tidegrid.llm import byte_bpe
from tidegrid.llm.queries import QUERIES

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "the", "'", "'re", "'s", " ", "  ", "\n", "\t", "é", "12", "!!", "\x1c", "\x85", "漢字", "ve", "😀", "x" * 90]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_tree_equals_plain_encoding(plain, leaf, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAF_CHARS", leaf)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", leaf)
    vocabulary, pick = byte_bpe.load_vocabulary(PATH, P.PATTERN), random.Random(leaf)
    vocabulary.tokens.clear()
    for _ in range(300):
        text = "".join(pick.choice(PARTS) for _ in range(pick.choice((0, 3, 40))))
        ids = vocabulary.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_long_runs(plain):
    vocabulary = byte_bpe.load_vocabulary(PATH, P.PATTERN)
    for text in ("a" * 20_001, "é漢" * 9_000, " " * 9_000 + "x"):
        assert vocabulary.encode(text) == plain.encode_ordinary(text)


def test_query_on_whole_table(spark, sf_dir, documents, plain):
    got = {r.doc_id: r for r in QUERIES["op1_byte_bpe"](spark, sf_dir).collect()}
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        ids = plain.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_repeats_and_empty_table(spark, docs):
    rows = [(1, None), (1, None), (None, "a b"), (2, "")]
    got = byte_bpe.encode_documents(docs(rows, "token_ids"), PATH, P.PATTERN).collect()
    assert sorted((r.n_tokens, r.doc_id or 0) for r in got) == [(0, 1), (0, 1), (0, 2), (2, 0)]
    assert all(len(r.token_ids) == 4 * r.n_tokens for r in got)
    assert byte_bpe.encode_documents(docs([]), PATH, P.PATTERN).count() == 0
