"""A tolerant block tree of an HTML page: block elements, and the runs of text between them.

Inline elements don't make nodes; they only count characters inside links. Raw text (scripts,
styles and the like), comments and everything in ``head`` give no text, nor does ``noscript``
outside of an article or main part. Optional end tags are supplied, unknown end tags skipped, and
an element without text (a player, a list of options) ends where what surrounds it ends. A head without an end tag ends at the first start tag or
text that can't stand in it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Comments, declarations, end tags, start tags; a start tag with a quote that nothing closes ends at the next ">".
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|style|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe canvas audio video select datalist head".split())
_IN_HEAD = frozenset("html head title meta link style script base basefont bgsound noscript noframes template".split())
_RAW_TEXT = frozenset("script style textarea title iframe".split())
_CLOSES_P = BLOCKS - {"body", "html", "button", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup"}
#: Elements that a start tag ends, up to the nearest element of the second set.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}


@dataclass
class Node:
    """A block element, or a run of text if ``tag`` is empty."""

    tag: str
    parent: int
    depth: int
    words: tuple[str, ...] = ()
    text: str = ""
    linked: int = 0
    children: list[int] = field(default_factory=list)


def _attribute_words(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id, role and the like; plural endings are cut off."""
    found = []
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            found.append("hidden")
        elif name != "style":
            found += (w.lower() for w in _PARTS.findall(value))
    return tuple(dict.fromkeys(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in found))


class _Open:
    """A stack of open elements that knows the last place of every tag."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.items: list[int] = []
        self._places: dict[str, list[int]] = {}

    def push(self, tag: str, item: int = 0) -> None:
        self._places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.items.append(item)

    def last(self, tag: str) -> int:
        """Place of the innermost open ``tag``, or -1."""
        places = self._places.get(tag)
        return places[-1] if places else -1

    def cut(self, upto: int) -> None:
        """Close all elements from a place on."""
        for tag in self.tags[upto:]:
            self._places[tag].pop()
        del self.tags[upto:], self.items[upto:]


def parse(page: str) -> list[Node]:
    """Nodes in page order; node 0 is the page. Time is linear in the page: open elements are found by tag."""
    nodes, stack, raw = [Node("page", -1, 0)], _Open(), _Open()
    stack.push("page", 0)
    text: list[str] = []
    at, links, linked, lower = 0, 0, 0, None

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            top = stack.items[-1]
            nodes[top].children.append(len(nodes))
            nodes.append(Node("", top, nodes[top].depth + 1, text=joined, linked=min(linked, len(joined))))
        linked = 0

    def close(upto: int) -> None:
        flush()
        stack.cut(upto)

    for m in iter(lambda: _MARKUP.search(page, at), None):
        if raw.tags == ["head"] and page[at : m.start()].strip():
            raw.cut(0)
        if not raw.tags:
            piece = page[at : m.start()]
            text.append(piece)
            linked += len(piece) if links else 0
        at = m.end()
        end, tag = (m[1] or "").lower(), (m[2] or "").lower()
        attributes = (m[3] or "").removesuffix(">")
        if end:
            inside = raw.last(end)
            if inside >= 0:
                raw.cut(inside)
            elif raw.tags and raw.last("head") < 0 and end in BLOCKS and stack.last(end) > 0:
                raw.cut(0)  # the end of what surrounds an element without an end tag
            if raw.tags or inside >= 0:
                continue
            if end == "a":
                links = 0
            elif end in BLOCKS and stack.last(end) > 0:
                close(stack.last(end))
        elif tag:
            if tag == "body" and raw.last("head") >= 0 or raw.tags == ["head"] and tag not in _IN_HEAD:
                raw.cut(0)
            hidden = tag in RAW or tag == "noscript" and max(stack.last("article"), stack.last("main")) < 0
            if raw.tags or hidden:
                if tag not in VOID and not attributes.endswith("/"):
                    if tag in _RAW_TEXT:
                        lower = page.lower() if lower is None or len(lower) != len(page) else lower
                        where = (lower if len(lower) == len(page) else page).find(f"</{tag}", at)
                        at = len(page) if where < 0 else where
                    raw.push(tag)
                    flush()
            elif tag == "a":
                links = 1
            elif tag == "br":
                text.append(" ")
            elif tag in BLOCKS:
                flush()
                if tag in _CLOSES_P:
                    paragraph = stack.last("p")
                    if paragraph > max(map(stack.last, ("td", "th", "button"))):
                        close(paragraph)
                ends, within = _SIBLINGS.get(tag, ((), ()))
                if ends:
                    border = max(map(stack.last, within))
                    while (sibling := max(map(stack.last, ends))) > border:
                        close(sibling)
                if tag not in VOID:
                    top = stack.items[-1]
                    nodes[top].children.append(len(nodes))
                    nodes.append(Node(tag, top, nodes[top].depth + 1, _attribute_words(attributes)))
                    stack.push(tag, len(nodes) - 1)
    if not raw.tags or raw.tags == ["head"]:
        text.append(page[at:])
    flush()
    return nodes
