"""Main text of pages: the tree, the marginals and the extracted text against plain versions."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from drowse.llm import main_text as m


@pytest.fixture(scope="module")
def model():
    return m.train(m.labelled_pages())


def plain(source):
    """Text of pages of the tables: heading and paragraphs of <article>."""
    blocks = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1])
    lines = (" ".join(html.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_query_against_plain(spark, sf):
    want = {r["page_id"]: (r["url"], plain(r["html"])) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = m.op11_main_text(spark, sf).collect()
    assert len(got) == len(want)
    assert all((r["url"], r["text"]) == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


def test_marginals_against_all_states():
    """Message passing against the sum over all 2 ** n states of small trees."""
    rng = np.random.default_rng(1)
    for _ in range(6):
        pages = [m.parse(m._Maker(random.Random(int(rng.integers(99)))).page()) for _ in range(2)]
        for p in pages:
            n = 6
            p.parent, p.tag, p.words, p.mark, p.texts = p.parent[:n], p.tag[:n], p.words[:n], p.mark[:n], []
        trees = m.forest(pages, {})
        own, edges = rng.normal(size=(12, 2)), rng.normal(size=(m.KINDS, 2, 2))
        one, pair = m.sum_product(trees, own, edges)
        states = np.array(list(itertools.product((0, 1), repeat=12)))
        child = np.flatnonzero(trees.parent >= 0)
        score = own[np.arange(12), states].sum(1) + edges[trees.kind[child], states[:, trees.parent[child]], states[:, child]].sum(1)
        w = np.exp(score - score.max())
        w /= w.sum()
        assert np.allclose(one[:, 1], w @ states)
        for c in child:
            both = w @ ((states[:, trees.parent[c]] == 1) & (states[:, c] == 1))
            assert np.isclose(pair[c, 1, 1], both)


def test_held_out_layouts(model):
    """Pages of layouts that were not trained on: nearly all elements right, most pages whole."""
    pages = [m.parse(m._Maker(random.Random(100_000 + i)).page()) for i in range(200)]
    main = m.marginals(pages, model) >= m.LIMIT
    told = np.array([x for p in pages for x in p.mark])
    assert (main == told).mean() > 0.99
    at, whole = 0, 0
    for p in pages:
        n = len(p.parent)
        whole += m.text_of(p, main[at : at + n]) == m.text_of(p, told[at : at + n])
        at += n
    assert whole > 180


def test_hand_made_page(model):
    page = """<!doctype html><html><head><title>No</title><style>a{b:c}</style></head><body><header class="site-header"><a href="/">Home of news</a></header>
<nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav><div class="cookie-notice">We use cookies. <button>Fine</button></div>
<main class="content"><h1>Rivers &amp; caf&eacute;s</h1><p>The first  paragraph has a <a href="/x">link</a> in it, and it goes on for a while.</p><div class="ad">Buy now. <a href="/y">More</a></div>
<p>Unclosed <b>bold<br>text that also goes on for some time, as texts do.<p>A third one, with &lt;angles&gt; and &copy;. It ends here.<ul><li>One item of a list<li>Another item</ul>
<script>var t = "</p><p>no</p>";</script></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Something else to read</a></ul></aside>
<section id="comments"><div class="comment"><b>Ann</b>: <p>I do not agree with this at all.</p></div></section><form class="newsletter"><label>Mail</label><input></form><footer>&copy; 2024 Someone</footer></body></html>"""
    want = ["Rivers & cafés", "The first paragraph has a link in it, and it goes on for a while.", "Unclosed bold text that also goes on for some time, as texts do.", "A third one, with <angles> and ©. It ends here.", "One item of a list", "Another item"]
    assert m.extract_texts([page], model)[0].split("\n") == want


def test_odd_pages(model):
    assert m.extract_texts([None, "", "<", "<p", "<!-- never closed <p>x</p>", "<script>x"], model) == [""] * 6
    body = "<p>A paragraph that says something here. It has two sentences.</p>"
    deep = "<div>" * 3000 + f"<article><h1>Title</h1>{body * 3}</article>"
    assert m.extract_texts([deep], model)[0].startswith("Title\nA paragraph")
    many = f"<body><article><h1>Long</h1>{body * 5000}</article><footer>&copy; x</footer></body>"
    assert m.extract_texts([many], model)[0].count("\n") == 5000


def test_ids_nulls_and_clashing_columns(spark, model):
    page = "<article><h1>Title of it</h1><p>Some text here. And more of it.</p></article>"
    rows = [(2**53 + 1, "u", page, "x"), (None, None, page, "x"), (7, "v", None, "x"), (7, "v", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = m.extract(df, model, beside=("url",)).collect()
    text = "Title of it\nSome text here. And more of it."
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=key) == sorted([(2**53 + 1, "u", text), (None, None, text), (7, "v", ""), (7, "v", "")], key=key)
    assert m.extract(df.limit(0), model).count() == 0
