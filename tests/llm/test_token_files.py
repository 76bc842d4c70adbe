import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import token_files as T
from tidegrid.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert T.unpack_block(memoryview(T.pack_block(ids))).tolist() == ids.tolist()


def test_segment_reads_any_range():
    ids = np.arange(3 * T.BLOCK + 17, dtype=np.uint32) ** 2 % 50_257
    segment = T.Segment(T.pack_segment([4, 9], [5, len(ids) - 5], ids))
    assert segment.doc_ids.tolist() == [4, 9]
    for a, b in ((0, 0), (0, 5), (4090, 4100), (T.BLOCK, 2 * T.BLOCK), (5, len(ids)), (len(ids) - 1, len(ids))):
        assert segment.ids(a, b).tolist() == ids[a:b].tolist()


def test_outliers_don_t_widen_a_block():
    ids = np.full(T.BLOCK, 7, np.uint32)
    ids[::50] = 50_000
    assert len(T.pack_block(ids)) < 1000


@pytest.mark.parametrize("kept", [3, 400_000])
def test_pieces_give_the_library_s_ids(kept, monkeypatch):
    monkeypatch.setattr(T, "_KEPT", kept)
    encoder, plain = T.TextEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("", "a", "it's  we'll\n\n x\t\x1cy\x85z", "é漢字 😀 12ab", "a<|endoftext|>b", " " * 9 + "x" * 99, "the the  the"):
        for _ in range(2):
            assert list(struct.unpack(f"<{len(b := encoder.encode(text)) // 4}I", b)) == plain.encode(text, add_special_tokens=False).ids


def expected(rows):
    plain, start, made = Tokenizer.from_file(PATH), 0, []
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        made.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return made


def test_query_on_whole_table(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in QUERIES["op2_token_files"](spark, sf_dir).collect())
    assert got == expected(sorted(documents.items()))


def test_nulls_repeats_segments_and_empty_table(spark, docs, monkeypatch):
    rows = [(3, "a b"), (1, None), (None, "x"), (3, "a b"), (2, "")]
    got = sorted((tuple(r) for r in T.tokens_on_file(docs(rows, "shard"), PATH).collect()), key=lambda r: r[1])
    assert got == expected([(None, "x"), (1, None), (2, ""), (3, "a b"), (3, "a b")])
    assert T.tokens_on_file(docs([]), PATH).count() == 0


def test_words_before_marks_are_kept_once():
    encoder, plain = T.TextEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ("one word. one, word!? one", "word's word-word. é.. é", "word.\n word,\x1c(word)"):
        assert list(struct.unpack(f"<{len(b := encoder.encode(text)) // 4}I", b)) == plain.encode(text, add_special_tokens=False).ids
    assert {" word", "."} <= set(encoder._known) and not {" word.", " one,", " word!?"} & set(encoder._known)
