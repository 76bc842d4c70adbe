r"""Secret scan with multipart linking.

Each text is scanned for base spans of three kinds (assignments, access identifiers, long
hexadecimal runs) and for weak parts: endpoints (urls with a host), user names (``user``,
``username``, ``login``, ``account`` assigned a value) and token-like strings of mixed
characters. A weak part alone is no finding. Its scope is the text up to ``scope`` characters
around it; it is interval-joined with the parts of complementary roles in that scope and
reported only if they co-occur: an identifier needs a secret, a secret needs an identifier, an
endpoint needs both. Base spans are always reported.

The join is two look-ups in spans ordered by start, so a text with many spans costs no more
than sorting them.

Nulls count as empty text. Repeated rows and ids are kept as they are.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.storage import map_texts, text_or_empty

#: Fixed patterns and least lengths of the base kinds, in the order of ties.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
BASE = ("assign", "access", "hex")

#: Weak parts: reported only with their complements.
ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]{1,10}://[^\s\"'<>]{4,}", re.ASCII)
USER = re.compile(r"""\b(?:user(?:name|_?id)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
DIGIT = re.compile("[0-9]")
WEAK = ("endpoint", "user", "opaque")

#: What a span can be in a credential.
IDENTIFIERS, SECRETS = {"access", "user"}, {"assign", "hex", "opaque"}
SCOPE = 400

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def weak_spans(text: str) -> list[Span]:
    found = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    found += [("user", *m.span()) for m in USER.finditer(text)] if ":" in text or "=" in text else []
    return found + ([("opaque", *m.span()) for m in OPAQUE.finditer(text)] if DIGIT.search(text) else [])


class Intervals:
    """Spans in order of start, with the greatest end so far: an interval join is two look-ups."""

    def __init__(self, spans: list[Span]):
        ordered = sorted(s[1:] for s in spans)
        self.starts = [s for s, _ in ordered]
        self.own_ends = sorted(e for _, e in ordered)
        self.ends = list(itertools.accumulate((e for _, e in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        """Whether one of the spans has a character in [start, end)."""
        before = bisect.bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start

    def beside(self, start: int, end: int, scope: int) -> bool:
        """Whether one of the spans lies within ``scope`` before ``start`` or after ``end``, and shares no character with [start, end)."""
        k = bisect.bisect_right(self.own_ends, start)
        if k and self.own_ends[k - 1] > start - scope:
            return True
        k = bisect.bisect_left(self.starts, end)
        return k < len(self.starts) and self.starts[k] < end + scope

    def holds(self, start: int, end: int) -> bool:
        """Whether one of the spans contains [start, end)."""
        before = bisect.bisect_right(self.starts, start)
        return before > 0 and self.ends[before - 1] >= end


def linked(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans, not part of a base span, that a complete credential within their scope contains.

    A base span inside of an endpoint counts as its part; one inside of a user name or a token is not a part beside it.
    A weak part never completes one that it overlaps: a token within a user name is not beside it.
    """
    if not weak:
        return []
    covered = Intervals(base)
    weak = [w for w in weak if not covered.holds(*w[1:])]
    identifiers, secrets = ([Intervals([p for p in parts if p[0] in role]) for parts in (base, weak)] for role in (IDENTIFIERS, SECRETS))

    def complete(kind: str, start: int, end: int) -> bool:
        reach = max(0, start - scope), end + scope
        sides = [reach] if kind == "endpoint" else [(reach[0], start), (end, reach[1])]
        needed = [secrets] if kind in IDENTIFIERS else [identifiers] if kind in SECRETS else [identifiers, secrets]
        return all(of_weak.beside(start, end, scope) or any(of_base.meets(*side) for side in sides) for of_base, of_weak in needed)

    return [w for w in weak if complete(*w)]


def listed(spans: list[Span]) -> str:
    kinds = BASE + WEAK
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]), x[2])))


def scan(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 and ``spans`` (kind:start:end in code points, end exclusive)."""

    def rows(columns):
        made = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")} | {"id": columns["id"]}
        for text in columns["text"]:
            base = base_spans(text)
            for kind in BASE:
                made[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            made["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            made["spans"].append(listed(base + linked(base, weak_spans(text), scope)))
        return made

    columns = [F.col(id_column).cast("bigint").alias("id"), text_or_empty(df, text_column).alias("text")]
    schema = "id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_texts(df, columns, schema, rows).withColumnRenamed("id", id_column)
