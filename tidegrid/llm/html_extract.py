"""Main text of web pages by a tree-structured graphical model.

Every node of a page's block tree carries a hidden label: content or not. A node's potential is
a weighted sum of its features (tag, words of class and id, length, links, punctuation), a
parent and a child are tied by a potential that depends on both labels and the kind of child.
Sum-product messages, up from the leaves and down from the root, give exact marginals, level by
level for all pages of a batch at once. Text whose marginal for content is above one half is
the main text.

Weights maximise the likelihood of labelled pages; its gradient is the observed minus the
expected number of each feature, and the expectations are the same marginals. The labelled
pages are (a) at most ``sample`` pages, those with the smallest hash of their id, that state
their own structure (exactly one ``article`` or ``main``): text inside it is content, but not in
nested navigation, asides, forms and the like; a third of them is shown without those telling tags, so
other features must explain the labels; and (b) pages composed by rule from common layouts
(``example_pages``), so that menus, notices, comments and other furniture are known by their
usual names even where the sample has none. The model is a table of a few thousand weights.

Nulls count as empty pages, whose text is empty. Repeated rows and ids are kept as they are.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.html_tree import Node, parse
from tidegrid.llm.storage import map_texts, text_or_empty

SAMPLE = 400
EXAMPLES = 600
ROUNDS = 150
#: Tags by which a page states its structure, and those that exclude text again.
MAIN = ("article", "main")
FURNITURE = frozenset("nav footer aside form header menu dialog button fieldset".split())
TELLING = frozenset(MAIN) | FURNITURE


def _bucket(x: float) -> int:
    return int(math.log2(x + 1))


def features(nodes: list[Node], telling: bool = True) -> list[list[str]]:
    """Names of the features of every node; without ``telling`` tags they look like plain divisions.

    ``within`` is the nearest telling tag around a node.
    """
    size, link, tags = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        n = nodes[i]
        size[i] += len(n.text)
        link[i] += n.linked
        tags[i] += 1
        size[n.parent] += size[i]
        link[n.parent] += link[i]
        tags[n.parent] += tags[i]
    made, near = [], []
    for i, n in enumerate(nodes):
        near.append(n.tag if n.tag in TELLING else near[n.parent] if n.parent >= 0 else "")
        share = int(4 * link[i] / max(1, size[i]))
        if not n.tag:
            above = nodes[n.parent]
            tag = above.tag if telling or above.tag not in TELLING else "div"
            own = ["text", f"in:{tag}", f"links:{share}", f"chars:{min(9, _bucket(len(n.text)))}"]
            own += ["stop"] if n.text[-1] in ".!?:;" else ["open"]
            own += ["mark"] if any(c in n.text for c in "©®|»") else []
            made.append(own + [f"within:{near[i]}"] * (telling and near[i] != ""))
        else:
            tag = n.tag if telling or n.tag not in TELLING else "div"
            own = ["block", f"tag:{tag}", f"block-links:{share}", f"block-chars:{min(12, _bucket(size[i]))}", f"block-parts:{min(6, _bucket(tags[i]))}"]
            made.append(own + [f"word:{w}" for w in n.words] + [f"block-within:{near[i]}"] * (telling and near[i] != ""))
    return made


def kind(node: Node) -> int:
    """The kind of tie to the parent: text, or a block."""
    return 0 if not node.tag else 1


# Messages.


class Forest:
    """Trees of one or more pages: parents, levels and kinds as arrays."""

    def __init__(self, pages: list[list[Node]]):
        offset, parent, depth, kinds = 0, [], [], []
        for nodes in pages:
            parent += [n.parent + offset if n.parent >= 0 else -1 for n in nodes]
            depth += [n.depth for n in nodes]
            kinds += [kind(n) for n in nodes]
            offset += len(nodes)
        self.parent, self.kind = np.array(parent, np.int64), np.array(kinds, np.int64)
        depth = np.array(depth, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
        self.levels = np.split(order, cuts)

    def marginals(self, unary: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node marginals [n, 2] and parent-child marginals [n, parent, child] by sum-product.

        ``unary`` [n, 2] and ``ties`` [kinds, parent, child] are log-potentials.
        """
        n = len(self.parent)
        up, message, down = unary.copy(), np.zeros((n, 2)), np.zeros((n, 2))
        tie = ties[self.kind]
        for level in reversed(self.levels[1:]):
            message[level] = _logsum(up[level][:, None, :] + tie[level], axis=2)
            np.add.at(up, self.parent[level], message[level])
        pairs = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            p = self.parent[level]
            outside = up[p] + down[p] - message[level]
            joint = outside[:, :, None] + tie[level] + up[level][:, None, :]
            pairs[level] = np.exp(joint - _logsum(_logsum(joint, axis=2), axis=1)[:, None, None])
            down[level] = _logsum(outside[:, :, None] + tie[level], axis=1)
        whole = up + down
        return np.exp(whole - _logsum(whole, axis=1)[:, None]), pairs


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


# Model.


@dataclass(frozen=True)
class TreeModel:
    weights: dict[str, float]
    ties: np.ndarray

    def content(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """Marginal of content per node, page by page."""
        unary = np.zeros((sum(map(len, pages)), 2))
        scores = [math.fsum(self.weights.get(f, 0.0) for f in own) for nodes in pages for own in features(nodes)]
        unary[:, 1] = scores
        found = Forest(pages).marginals(unary, self.ties)[0][:, 1]
        return np.split(found, np.cumsum([len(p) for p in pages])[:-1])

    def texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        return [" ".join(n.text for n, p in zip(nodes, shares, strict=True) if n.text and p > 0.5) for nodes, shares in zip(trees, self.content(trees), strict=True)]


def fit(pages: list[tuple[list[Node], list[int], bool]], rounds: int = ROUNDS, ridge: float = 1e-3) -> TreeModel:
    """Weights of greatest likelihood for (nodes, labels, telling) pages, by adaptive gradient steps."""
    names: dict[str, int] = {}
    rows, columns = [], []
    for at, f in enumerate(f for nodes, _, telling in pages for f in features(nodes, telling)):
        rows += [at] * len(f)
        columns += [names.setdefault(x, len(names)) for x in f]
    labels = np.array([x for _, own, _ in pages for x in own])
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    forest = Forest([nodes for nodes, _, _ in pages])
    inner = np.flatnonzero(forest.parent >= 0)
    observed = np.bincount(columns, labels[rows], len(names))
    tied = np.zeros((2, 2, 2))
    np.add.at(tied, (forest.kind[inner], labels[forest.parent[inner]], labels[inner]), 1)
    w, ties, seen_w, seen_t = np.zeros(len(names)), np.zeros((2, 2, 2)), np.full(len(names), 1e-8), np.full((2, 2, 2), 1e-8)
    for _ in range(rounds):
        unary = np.zeros((len(labels), 2))
        unary[:, 1] = np.bincount(rows, w[columns], len(labels))
        nodes, pairs = forest.marginals(unary, ties)
        gw = observed - np.bincount(columns, nodes[rows, 1], len(names)) - ridge * len(pages) * w
        gt = tied - np.stack([pairs[inner][forest.kind[inner] == k].sum(axis=0) for k in (0, 1)]) - ridge * len(pages) * ties
        seen_w, seen_t = seen_w + gw**2, seen_t + gt**2
        w, ties = w + 0.5 * gw / np.sqrt(seen_w), ties + 0.5 * gt / np.sqrt(seen_t)
    return TreeModel({f: float(w[i]) for f, i in names.items()}, ties)


# Labelled pages.


def own_labels(nodes: list[Node]) -> list[int] | None:
    """Labels from the page's own structure, or None if it states none."""
    mains = [i for i, n in enumerate(nodes) if n.tag in MAIN]
    if len(mains) != 1:
        return None
    inside = [0] * len(nodes)
    for i, n in enumerate(nodes):
        if n.parent >= 0:
            inside[i] = int((inside[n.parent] or i in mains) and n.tag not in FURNITURE)
    return _with_ancestors(nodes, inside)


def _with_ancestors(nodes: list[Node], inside: list[int]) -> list[int]:
    """Blocks around content are content if most of their text is."""
    text, good = [len(n.text) for n in nodes], [len(n.text) * x for n, x in zip(nodes, inside, strict=True)]
    for i in range(len(nodes) - 1, 0, -1):
        text[nodes[i].parent] += text[i]
        good[nodes[i].parent] += good[i]
    return [x if not n.tag else int(2 * g > t) if t else x for n, x, g, t in zip(nodes, inside, good, text, strict=True)]


#: Names that layouts commonly give to parts of a page; fixed vocabulary of the composed pages.
_CONTENT_NAMES = "article content entry post story main body text page-content article-body post-content entry-content".split()
_FURNITURE_NAMES = (
    "nav navigation navbar menu main-menu header site-header top-bar masthead footer site-footer bottom sidebar side-bar widget aside "
    "notice cookie-notice cookie-banner consent alert popup modal overlay ad ads advert advertisement adsbygoogle promo sponsored banner "
    "form search login signup newsletter subscribe comments comment comment-list reply discussion respond disqus related recommended "
    "share social breadcrumb breadcrumbs pagination pager tags meta byline copyright legal skip toolbar"
).split()
_FURNITURE_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "dialog"}


def example_page(pick: random.Random) -> tuple[list[Node], list[int]]:
    """A page composed by rule, and its labels; content is marked while the page is written."""
    word = lambda: "".join(pick.choice(("ta", "re", "on", "mi", "shu", "el", "ko", "ar", "en", "is")) for _ in range(pick.randint(1, 4)))
    phrase = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda: phrase(pick.randint(2, 18)).capitalize() + pick.choice("...!?")
    prose = lambda: " ".join(sentence() for _ in range(pick.choice((1, 1, 2, 3, 6))))
    mark = "⁣"  # an invisible character stands before every text of the content

    def furniture() -> str:
        name = pick.choice(_FURNITURE_NAMES)
        links = lambda n: "".join(f"<li><a href='/x'>{phrase(pick.randint(1, 3))}</a></li>" for _ in range(n))
        inner = pick.choice((
            lambda: f"<ul>{links(pick.randint(2, 7))}</ul>",
            lambda: f"<p>{prose()}</p>",
            lambda: prose(),
            lambda: f"<h3>{phrase(2)}</h3><ul>{links(3)}</ul>",
            lambda: f"<div><p>{sentence()}</p><a href='#'>{phrase(2)}</a></div>",
            lambda: f"<h1>{phrase(pick.randint(1, 3))}</h1><ul>{links(pick.randint(2, 6))}</ul>",
            lambda: f"<{(h := pick.choice(('h1', 'h1', 'h2')))}>{phrase(pick.randint(1, 3))}</{h}>",
            lambda: f"&copy; {phrase(2)} &middot; {sentence()}",
            lambda: f"<h3>{phrase(1)}</h3>" + "".join(f"<div><b>{word()}</b><p>{prose()}</p></div>" for _ in range(pick.randint(1, 4))),
            lambda: f"<label>{phrase(2)}</label><input><button>{word()}</button>",
        ))()
        tag = pick.choice([*_FURNITURE_TAGS, "div", "div", "section", "ul" if inner.startswith("<li") else "div"])
        named = f" {pick.choice(('class', 'class', 'id'))}='{name}'" if tag in ("div", "section") or pick.random() < 0.5 else ""
        return f"<{tag}{named}>{inner}</{tag}>"

    def content() -> str:
        parts = [f"<h1>{mark}{phrase(pick.randint(2, 9))}</h1>"] if pick.random() < 0.8 else []
        for _ in range(pick.randint(1, 9)):
            parts.append(pick.choice((
                lambda: f"<p>{mark}{prose()}</p>",
                lambda: f"<p>{mark}{prose()}",
                lambda: f"<p>{mark}{prose()} <a href='/y'>{phrase(2)}</a> {phrase(4)}.</p>",
                lambda: f"<h2>{mark}{phrase(pick.randint(1, 5))}</h2><p>{mark}{prose()}</p>",
                lambda: f"<ul>{''.join(f'<li>{mark}{phrase(pick.randint(1, 8))}</li>' for _ in range(3))}</ul>",
                lambda: f"<blockquote>{mark}{prose()}</blockquote>",
                lambda: f"<p>{mark}{prose()}</p><p>{mark}{prose()}</p>",
                lambda: f"<table><tr><td>{mark}{phrase(2)}</td><td>{mark}{phrase(1)}</td></tr></table>",
                lambda: f"<pre>{mark}{prose()}</pre>",
            ))())
            if pick.random() < 0.08:
                parts.append(furniture())
        if pick.random() < 0.1:
            return "".join(parts) if pick.random() < 0.6 else mark + prose()
        tag = pick.choice(("article", "main", "div", "div", "section"))
        named = f" {pick.choice(('class', 'id'))}='{pick.choice(_CONTENT_NAMES)}'" if tag in ("div", "section") and pick.random() < 0.85 else ""
        return f"<{tag}{named}>{''.join(parts)}</{tag}>"

    most = pick.choice((0, 4, 4, 4, 4, 4, 4, 4))
    before, after = ("".join(furniture() for _ in range(pick.randint(min(1, most), most))) for _ in range(2))
    body = before + content() + after
    for _ in range(pick.randint(0, 2)):
        body = f"<div{pick.choice(('', chr(32) + 'class=wrapper', chr(32) + 'id=page'))}>{body}</div>"
    nodes = parse(f"<html><head><title>{phrase(3)}</title></head><body>{body}</body></html>")
    inside = [int(n.text.startswith(mark)) for n in nodes]
    for n in nodes:
        n.text = n.text.lstrip(mark)
    return nodes, _with_ancestors(nodes, inside)


def train(pages: DataFrame, *, sample: int = SAMPLE, examples: int = EXAMPLES, html_column: str = "html") -> TreeModel:
    """Fit on composed pages and on at most ``sample`` pages that state their own structure."""
    html = text_or_empty(pages, html_column)
    stated = pages.select("page_id", F.xxhash64(html).alias("mark"), html.alias("html")).where(F.lower("html").rlike("<(article|main)[\\s>]"))
    # Ids are chosen first: with the pages themselves, every task would send ``sample`` of them.
    chosen = stated.select("page_id", "mark").orderBy(F.xxhash64("page_id", "mark"), "page_id").limit(sample).distinct()
    same_page = F.col("s.page_id").eqNullSafe(F.col("c.page_id")) & (F.col("s.mark") == F.col("c.mark"))
    found = stated.alias("s").join(F.broadcast(chosen).alias("c"), same_page).select("s.mark", "html").dropDuplicates(["mark"])
    pick, labelled = random.Random(23), []
    for k in range(examples):
        labelled.append((*example_page(pick), k % 3 != 0))
    for k, row in enumerate(sorted(r.html for r in found.collect())):
        nodes = parse(row)
        labels = own_labels(nodes)
        if labels is not None:
            labelled.append((nodes, labels, k % 3 != 0))
    return fit(labelled)


def extract(pages: DataFrame, model: TreeModel, html_column: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""

    def rows(columns):
        texts = model.texts(columns["html"])
        return {"page_id": columns["page_id"], "url": columns["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    columns = [F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), text_or_empty(pages, html_column).alias("html")]
    return map_texts(pages, columns, "page_id bigint, url string, text string, n_chars bigint", rows)
