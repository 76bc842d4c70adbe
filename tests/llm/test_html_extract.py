import html
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from tidegrid.llm import html_extract as H
from tidegrid.llm.html_tree import parse
from tidegrid.llm.queries import QUERIES


def article(page):
    """Text of a page whose article has no furniture inside, by plain substitution."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return H.train(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def test_query_on_whole_table(spark, sf_dir):
    rows = {i: (u, h) for i, u, h in duckdb.sql(f"SELECT page_id, url, html FROM '{sf_dir}/pages.parquet'").fetchall()}
    got = {r.page_id: r for r in QUERIES["op6_html_extract"](spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for i, (url, page) in rows.items():
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, article(page), len(article(page)))


def test_marginals_against_enumeration():
    pick = np.random.default_rng(3)
    nodes = parse("<div><p>a</p><ul><li>b<li>c</ul></div>")
    unary, ties, forest = pick.normal(size=(len(nodes), 2)), pick.normal(size=(2, 2, 2)), H.Forest([nodes])
    weight, single, pair = 0.0, np.zeros((len(nodes), 2)), np.zeros((len(nodes), 2, 2))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(unary[i, x] for i, x in enumerate(labels))
        e += sum(ties[H.kind(n), labels[n.parent], labels[i]] for i, n in enumerate(nodes) if n.parent >= 0)
        weight += np.exp(e)
        for i, n in enumerate(nodes):
            single[i, labels[i]] += np.exp(e)
            if n.parent >= 0:
                pair[i, labels[n.parent], labels[i]] += np.exp(e)
    nodes_got, pairs_got = forest.marginals(unary, ties)
    assert np.allclose(nodes_got, single / weight) and np.allclose(pairs_got, pair / weight)


def test_composed_pages_not_seen_in_training(model):
    pick, wrong, total = random.Random(77), 0, 0
    for _ in range(150):
        nodes, labels = H.example_page(pick)
        for n, want, p in zip(nodes, labels, model.content([nodes])[0], strict=True):
            if n.text:
                total, wrong = total + 1, wrong + ((p > 0.5) != want)
    assert total > 1000 and wrong < 0.03 * total


@pytest.mark.parametrize("telling", [True, False])
def test_furniture_of_another_layout(model, telling):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><nav><a href=1>Home</a>
    <a href=2>About</a></nav></header><div class="cookie-notice"><p>We use cookies. Accept?</p></div><div id="content"><article>
    <h2>Title &amp; more</h2><p>First  para<br>graph with <b>bold</b>&nbsp;text.<!-- no --></p><p>Second &#233;.</p>
    <script>var x = "</p><p>no";</script><form>Email <input><button>Go</button></form></article></div><div class="comments">
    <h3>Comments</h3><p>I liked this very much. Really good article, thanks!</p></div><div class=sidebar><p>Popular posts</p></div>
    <footer><p>(c) 2024</p></footer></body></html>"""
    if not telling:
        for tag, name in (("article", "post"), ("header", "header"), ("footer", "footer"), ("nav", "nav"), ("form", "form")):
            page = page.replace(f"<{tag}>", f"<div class={name}>").replace(f"</{tag}>", "</div>")
    assert model.texts([page]) == ["Title & more First para graph with bold text. Second é."]


def test_tolerant_parsing():
    text = lambda page: [n.text for n in parse(page) if n.text]
    assert text("<p>a<p>b<b>c<p>d") == ["a", "bc", "d"]
    assert text("x<script>if (a < b) '</p>'</script>y<!-- <p>z") == ["x", "y"]
    assert text("<ul><li>a<li>b</ul></div>c<style>") == ["a", "b", "c"]
    assert text("<title>t</title><body>&lt;p&gt; &copy;  x<br/>y < z") == ["<p> © x y < z"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert text("<div " * 3000) == [] and len(parse("<div>" * 3000)) == 3001


def test_nulls_repeats_and_empty_table(spark, model):
    schema = "page_id bigint, url string, html string, text string"
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<article><p>Some words, here.</p></article>", "x")]
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in H.extract(spark.createDataFrame(rows, schema), model).collect())
    assert got == [(0, "u", "Some words, here.", 17), (1, "", "", 0), (1, "u", "", 0)]
    assert H.extract(spark.createDataFrame([], schema), model).count() == 0
    page = "<nav><ul><li><a href=1>Home</a></li></ul></nav><main><h1>A title</h1><p>Some words are here, and a few more.</p><p>More.</p></main>"
    assert H.train(spark.createDataFrame([], schema)).texts([page]) == ["A title Some words are here, and a few more. More."]


def test_head_and_options_without_end_tags():
    text = lambda page: [n.text for n in parse(page) if n.text]
    assert text("<html><head><title>T</title><meta charset=x><script>a<b</script><article><p>text</p></article>") == ["text"]
    assert text("<head><title>T</title><noscript><img src=x></noscript><link rel=y> \n words <b>here</b>") == ["words here"]
    assert text("<head><title>T</title></head><p>a") == text("<head><style>p{}</style><body><p>a") == text("<head>a") == ["a"]
    assert text("<p>a</p><datalist id=d><option value=x>x<option value=y>y</datalist><p>b</p>") == ["a", "b"]
    assert text("<select><option>x<option>y</select><p>b</p>") == ["b"]


def test_comment_ends_and_odd_quotes():
    text = lambda page: [n.text for n in parse(page) if n.text]
    for comment in ("<!-->", "<!--->", "<!-- b --!>", "<!-- b -->", "<!---->", "<!-- > -- -->"):
        assert text(f"<p>a{comment}c</p>") == ["ac"], comment
    assert text("<p>a<!-- b") == ["a"]
    assert text("""<p title="it's>hello</p><p>more</p>""") == ["hello", "more"]
    assert text("""<p title='it"s'>hello</p>""") == ["hello"]


def test_text_inside_of_foreign_elements():
    text = lambda page: [n.text for n in parse(page) if n.text]
    page = "<article><p>a <math><mi>x</mi></math> <svg><style>p{}</style><title>t</title><text>label</text></svg> <object>b</object></p><noscript>c</noscript></article>"
    assert " ".join(text(page)) == "a x label b c"
    assert text("<noscript>Turn scripts on</noscript><article><p>a</p></article>") == ["a"]
    assert text("<div><p>a<video src=x>old</p><p>b</p></div>") == ["a", "b"]
    assert text("<div><canvas>old</div><p>b</p>") == ["b"]


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>" * 100_000, "<div><p>" * 50_000, "<ul><li>" * 50_000, "<svg><g>" * 50_000 + "</b>" * 50_000, "<select><b>" * 50_000 + "</i>" * 50_000):
        start = time.process_time()
        parse(page)
        assert time.process_time() - start < 5
