"""Byte-level BPE by monoid tree reduction.

A text is cut into halves until a leaf is small; leaves are split into pieces and encoded,
and neighbours are joined on the way up. A segment is the list of its pieces with their
tokens; a piece is one or more whole matches of the vocabulary's pattern (a word with its
leading space and punctuation, or white space). Two facts make a join exact:

* The pattern looks at most two characters past a match and never behind it. So a piece of
  the left segment that ends two characters or more before its end is final, and from a
  common piece start on, the pieces of the right segment are final.
* A token sequence is the encoding of its bytes exactly if every two neighbours are the
  encoding of theirs. So tokens outside a re-encoded window are final once the pairs at both
  of its ends are.

A join re-encodes a window over the boundary and doubles it until what lies outside is
final. Windows are a few pieces (or tokens) wide in practice; at worst one grows to both
segments, which is a plain encoding of them.

Nulls count as empty text; empty texts have no tokens. Repeated rows and ids are kept as
they are, other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import map_texts, text_or_empty

LEAF_CHARS = 4096
LEAF_BYTES = 64
LOOKAHEAD = 2
CACHE_ENTRIES = 100_000

#: White space as the pattern's library has it (the White_Space property).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Every border of these pieces is a border between matches of the vocabulary's pattern too.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class PieceTokens(dict):
    """Tokens by piece, looked up at C speed; a miss is encoded, and kept while there is room."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self._encode(piece)
        if len(self) < CACHE_ENTRIES and len(piece) <= LEAF_BYTES:
            self[piece] = found
        return found


class BpeVocabulary:
    """Ranks of byte sequences and the pattern that splits text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        self._core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token_bytes[rank] = token
        self.decimal = [str(i) for i in range(len(self.token_bytes))]
        self._whole = list(range(len(self.token_bytes)))  # one object per id, shared by all cached pieces
        self._pairs: dict[tuple[int, int], bool] = {}
        self.tokens = PieceTokens(self.encode_piece)

    # Tokens of one piece.

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of one piece by the tree: merges in leaves, windows where leaves meet."""
        if len(piece) <= LEAF_BYTES:
            return list(self._core.encode_single_piece(piece)) if piece else []
        half = len(piece) // 2
        return self.join_tokens(self.merge(piece[:half]), self.merge(piece[half:]))

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their own bytes."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) >= CACHE_ENTRIES:
                self._pairs.clear()
            both = self.token_bytes[left] + self.token_bytes[right]
            found = self._pairs[left, right] = list(self._core.encode_single_piece(both)) == [left, right]
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = list(self._core.encode_single_piece(b"".join(self.token_bytes[t] for t in left[a:] + right[:b])))
            if (a == 0 or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    # Pieces of a text.

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = [t for m in self.pattern.findall(piece) for t in self.merge(m.encode("utf-8"))]
        return tuple(map(self._whole.__getitem__, ids))

    def segment(self, text: str) -> tuple[list[str], list[tuple[int, ...]]]:
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            return self.join(self.segment(text[:half]), self.segment(text[half:]))
        pieces = PIECES.findall(text)
        return pieces, list(map(self.tokens.__getitem__, pieces))

    def join(self, left, right) -> tuple[list[str], list[tuple[int, ...]]]:
        """Segments of two texts to the segment of their concatenation."""
        (lp, lt), (rp, rt) = left, right
        if not lp or not rp:
            return (lp, lt) if lp else (rp, rt)
        reach = 2
        while True:
            a, b = max(0, len(lp) - reach), min(len(rp), reach)
            before, after = "".join(lp[a:]), "".join(rp[:b])
            pieces = PIECES.findall(before + after)
            whole = b == len(rp)
            if a == 0 or len(before) >= LOOKAHEAD:
                kept = self._meeting(pieces, rp[:b], len(before), len(before) + len(after), whole)
                if kept is not None:
                    mine, theirs = kept
                    pieces = pieces[:mine]
                    return lp[:a] + pieces + rp[theirs:], lt[:a] + [self.tokens[p] for p in pieces] + rt[theirs:]
            reach *= 2

    @staticmethod
    def _meeting(pieces, old, start, end, whole) -> tuple[int, int] | None:
        """Numbers of new and old pieces up to the first common border at or past ``start`` that is final."""
        if whole:
            return len(pieces), len(old)
        ends, at = {}, start
        for i, p in enumerate(old):
            ends[at] = i
            at += len(p)
        at = 0
        for i, p in enumerate(pieces):
            if at >= start and at in ends and at <= end - LOOKAHEAD:
                return i, ends[at]
            at += len(p)
        return None

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.segment(text)[1]))

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, concatenated up the same kind of tree."""
        if len(ids) > LEAF_CHARS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.token_bytes.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str, pattern: str) -> BpeVocabulary:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return BpeVocabulary(ranks, pattern)


def encode_documents(
    df: DataFrame, vocabulary_path: str, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", with_tokens: bool = True
) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas), and
    ``decoded_sha256`` of the bytes decoded from the ids; ``token_ids`` (32-bit little-endian)
    unless ``with_tokens`` is off.

    The vocabulary file must be at ``vocabulary_path`` on every executor.
    """

    def rows(columns):
        vocabulary = load_vocabulary(vocabulary_path, pattern)
        made = {"id": columns["id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "token_ids": []}
        for text in columns["text"]:
            ids = vocabulary.encode(text)
            made["n_tokens"].append(len(ids))
            made["ids_sha256"].append(hashlib.sha256(",".join(map(vocabulary.decimal.__getitem__, ids)).encode()).hexdigest())
            made["decoded_sha256"].append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            if with_tokens:
                made["token_ids"].append(pa.array(ids, pa.uint32()).buffers()[1].to_pybytes()[: 4 * len(ids)] if ids else b"")
        return made

    schema = "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * with_tokens
    columns = [F.col(id_column).cast("bigint").alias("id"), text_or_empty(df, text_column).alias("text")]
    return map_texts(df, columns, schema, rows).withColumnRenamed("id", id_column)
