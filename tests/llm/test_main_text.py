"""Blocks of pages, the labeller's gradients and accuracy, and main texts of whole pages."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.llm import main_text as M
from ebbflow.llm.blocks import leaves
from ebbflow.llm.common import table

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
SF = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in leaves(page)]


@pytest.mark.parametrize("page, expected", [
    (None, []), ("", []), ("   \n", []), ("plain  text\n here", ["plain text here"]),
    ("<p>a<br>b <b>c</b>d<p>e", ["a b cd", "e"]),
    ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", ["one", "two", "in", "three"]),
    ("<script>var a='<p>x</p>';</script><p>y</p><style>p{}</style>", ["y"]),
    ("<script>never ends <p>x</p>", []), ("a<!-- <p>x</p> -->b<!-- open <p>c", ["ab"]),
    ("<p title='a > b'>x</p><p title=it's>y</p>", ["x", "y"]),
    ("&lt;b&gt; &amp;amp; &#233;&#x41;&nbsp; z", ["<b> &amp; éA z"]),
    ("3 < 4 <5 and <", ["3 < 4 <5 and <"]), ("x</p>y</ >z", ["x", "yz"]), ("<P>A</P><DIV>B</DIV>", ["A", "B"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<title>no</title><textarea>no</textarea>yes", ["yes"]),
    ("<h2>a</h3><p>b", ["a", "b"]), ("<p>cut <a href='x", ["cut"])])
def test_blocks(page, expected):
    assert texts(page) == expected


def test_paths_hold_names_and_close():
    got = leaves('<body><div id="mainMenu" class="nav-bar x"><a href=1>in</a> out</div><article><header><h1>t</h1></header><p>u</article><p hidden>v')
    assert [b.path for b in got] == [("body", "div main menu nav bar x"), ("body", "article", "header", "h1"), ("body", "article", "p"),
                                     ("body", "p hidden")]
    assert [b.linked for b in got] == [2, 0, 0, 0]


@pytest.mark.parametrize("piece", ["<a", '<p class="', "<!--", "<script>", "<svg>", "<noscript>", "<div>", "<", "</ >", "<p>", "<ul><li>", "<a href='"])
def test_broken_markup_takes_linear_time(piece):
    t = time.time()
    leaves(piece * 60_000 + " t")
    assert time.time() - t < 5


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    steps, pages, n = 5, 3, 4
    z = rng.normal(size=(steps, pages, 4 * n)).astype(np.float32)
    u = (rng.normal(size=(n, 4 * n)) * 0.5).astype(np.float32)
    mask = np.ones((steps, pages, 1), np.float32)
    mask[3:, 1] = 0
    target = rng.normal(size=(steps, pages, n)).astype(np.float32)
    loss = lambda: float((M._forward(z, mask, u).astype(np.float64) * target).sum())
    kept = []
    M._forward(z, mask, u, kept)
    dz, du = M._backward(target, mask, u, kept)
    for array, gradient in ((z, dz * mask), (u, du)):
        for _ in range(25):
            at = tuple(rng.integers(s) for s in array.shape)
            old, step = array[at], np.float32(1e-2)
            array[at] = old + step
            up = loss()
            array[at] = old - step
            down = loss()
            array[at] = old
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-2


def test_accuracy_on_pages_it_has_not_seen():
    test = M.labelled(500, seed=12345)
    scores = M.trained().scores([b for b, _ in test])
    right = np.concatenate([(s >= 0.5) == (y > 0.5) for s, (_, y) in zip(scores, test)])
    assert right.mean() > 0.985
    assert np.mean([((s >= 0.5) == (y > 0.5)).all() for s, (_, y) in zip(scores, test)]) > 0.85


def test_scores_do_not_depend_on_the_batch():
    pages = [b for b, _ in M.labelled(40, seed=5)] + [[]]
    together = M.trained().scores(pages)
    for p, s in zip(pages, together):
        assert len(p) == len(s) and np.allclose(M.trained().scores([p])[0], s, atol=1e-4)


def by_hand(page):
    """Main text of the tables' own page form: the article's heading and paragraphs."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", article)
    found = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in found if t)


def test_whole_pages_table(spark):
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in M.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        text = by_hand(r["html"])
        assert got[r["page_id"]] == (r["url"], text, len(text))


OTHER = """<html><body><header><a href=/>Site</a></header><div class="cookie-notice"><p>We use cookies.</p></div>
<nav class=menu><a href=/1>One</a> <a href=/2>Two</a></nav><div id="content"><h1>How rivers bend</h1>
<p>Water &amp; sand move on the outer bank.</p><div class="advert"><p>Buy boots</p></div><h2>Why</h2>
<ul><li>Speed differs across the bed.</li><li>Banks wear away.</li></ul></div>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/3>Lakes</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Very nice text, thank you.</p></div></section>
<form action="/s"><label>Search</label><input><button>Go</button></form><footer><p>All rights reserved</p></footer></body></html>"""


def test_another_layout_and_odd_rows(spark):
    rows = [(1, "u", OTHER), (1, "u", OTHER), (2, None, None), (None, "x", ""), (3, "y", "<nav><a href=/>Home</a></nav>"),
            (4, "z", "<article><p>😀 café</p></article>".encode("utf-16", "surrogatepass").decode("utf-16"))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("q") for c in ("text", "n_chars", "score", "blocks")})
    main = "How rivers bend\n\nWater & sand move on the outer bank.\n\nWhy\n\nSpeed differs across the bed.\n\nBanks wear away."
    got = sorted(map(tuple, M.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", main, len(main))] * 2 + [(2, None, "", 0), (None, "x", "", 0), (3, "y", "", 0), (4, "z", "\U0001F600 café", 6)], key=str)
    shown = {r["page_id"]: r["blocks"] for r in M.blocks(df).collect()}
    assert "\n\n".join(b["text"] for b in shown[1] if b["main"]) == main and shown[2] == []
    assert any(b["path"].endswith("div.advert>p") and not b["main"] for b in shown[1])


def test_empty_table_and_long_page(spark):
    assert M.extract(spark.createDataFrame([], SCHEMA)).collect() == []
    page = "<article>" + "<p>Some words of a paragraph.</p>" * 20_000 + "</article>"
    got = M.extract(spark.createDataFrame([(1, "u", page)], SCHEMA)).first()
    assert got["text"].count("\n\n") == 19_999
