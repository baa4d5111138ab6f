import html
import re
import time

import numpy as np
import pytest

from entailis.llm import htmltext as H
from entailis.llm.queries import op2_htmltext


@pytest.fixture(scope="module")
def model():
    return H.train()


def plain(page):
    """The article by its tags, for pages of the test tables."""
    out = []
    for b in re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S)[1]):
        s = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", b))).split())
        if s:
            out.append(s)
    return "\n".join(out)


def test_pages(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = op2_htmltext(spark, data).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def test_held_out_generated_pages(model):
    wrong = total = 0
    for page in H.training_pages(200, seed=77):
        root = H.parse(page, marks=True)
        nodes, x = H.features(root)
        H.decode(root, nodes, model.predict(x))
        for n in nodes:
            if n.mark is not None:
                wrong += n.kept != n.mark
                total += 1
    assert wrong / total < 0.01


ONE = "Paragraph one has quite a few words in it, so that it reads like text. It goes on with a second sentence that is of some length, too. And then it has a third one, which is the last."
TWO = "The second paragraph tells something else, in other words. It is as long as the first one, or nearly so, and it says nothing new. " * 2
TWO = TWO.strip()
LAYOUTS = [  # pages that no part of the generator writes as they are
    (f"<body><h1>Title</h1><p>{ONE}</p><p>{TWO}</p></body>", ["Title", ONE, TWO]),
    (f'<div><div><div id="c1"><h2>T</h2><p>{ONE}</p><p>{TWO}</p></div></div></div>', ["T", ONE, TWO]),
    (f'<table><tr><td><a href="/">Home</a> <a href="/x">News</a></td><td><p>{ONE}</p><p>{TWO}</p></td></tr></table>', [ONE, TWO]),
    (f"<body>{ONE}<p>{TWO}</p></body>", [ONE, TWO]),
    (f"<body><h1>Title</h1>{ONE}<br>{TWO}<footer>&copy; 2020 Site</footer></body>", ["Title", f"{ONE} {TWO}"]),
    (f"<body><h1>Title</h1>{ONE}<hr>{TWO}</body>", ["Title", ONE, TWO]),
    (f'<article><p>{ONE} <span class="warning">danger text</span> {TWO}</p></article>', [f"{ONE} danger text {TWO}"]),
    (f'<article><p>{ONE}</p><p class="x>{TWO}</p></article>', [ONE, TWO]),
    (f"<html><body><center><font><p>{ONE}<p>{TWO}</font></center></body></html>", [ONE, TWO]),
    (f'<div class="wrap"><div class="topbar"><a href="/">Home</a></div><div class="txt"><div>{ONE}</div><div>{TWO}</div></div><div class="copyright">&copy; 2020</div></div>', [ONE, TWO]),
    (f"<main><section><h2>T</h2>{ONE}<ul><li>{TWO}</li></ul></section></main>", ["T", ONE, TWO]),
]


@pytest.mark.parametrize(("page", "lines"), LAYOUTS)
def test_layouts_without_hints(model, page, lines):
    assert H.extract([page], model)[0].split("\n") == lines


HARD = [
    *('<a "', '<a b="<"', "<a b= ", "<p class=\"", "<div>", "</a", "<!--", "<", "&", "<noscript>"),
    "<div>" * 40_000 + "</p>", "<x-y>" * 30_000 + "<h1></h1>", "<p><td>" + "<x>" * 30_000 + "<h1></h1>", "<script></script ",
]


@pytest.mark.parametrize("unit", HARD, ids=[u[:12] for u in HARD])
def test_time_is_linear(model, unit):
    page = unit * (1_000_000 // len(unit)) if len(unit) < 100 else unit + unit[-9:] * 30_000
    began = time.process_time()
    out = H.extract([page], model)
    assert time.process_time() - began < 10 and len(out[0]) <= len(page)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<div class="cookie-notice"><p>We use cookies, accept them.</p></div>
<header><a href="/">Site</a><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav></header>
<div class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other</a></li></ul></div>
<article><h1>A &amp; B</h1><p>First   paragraph, with <a href="/x">a link</a> and<br>a break.</p>
<div class="ad">Buy now</div><ul><li>Item one is here.</li><li>Item two is here.</li></ul><p>Last &lt;words&gt;&nbsp;of it.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked the article very much, thank you.</p></div></section>
<form><label>Search</label><input name="q"><button>Go</button></form><footer>&copy; Site</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_clutter_goes(model):
    assert H.extract([PAGE], model) == ["A & B\nFirst paragraph, with a link and a break.\nItem one is here.\nItem two is here.\nLast <words> of it."]


def test_decoding_has_no_kept_child_of_a_rejected_parent(model):
    rng = np.random.default_rng(1)
    for page in H.training_pages(20, seed=9):
        root = H.parse(page)
        nodes, _ = H.features(root)
        odds = rng.normal(0, 3, len(nodes))
        H.decode(root, nodes, odds)
        assert all(n.parent.kept for n in nodes if n.kept)
        assert all(n.kept == (o > 0) for n, o in zip(nodes, odds, strict=True) if n.parent.kept)


def test_tree():
    root = H.parse('<ul><li>a<li>b <i>c</i></ul><p>d<p x="1>2" y=\'<\'>e<table><tr><td>f<td>g</table>h<br>i')
    assert [n.name for n in H.nodes_of(root)] == ["ul", "li", "li", "p", "p", "table", "tr", "td", "td", "#run"]
    for n in H.nodes_of(root):
        n.kept = True
    assert H.text_of(root) == "a\nb c\nd\ne\nf\ng\nh i"


def test_odd_input(spark, model):
    odd = [None, "", "   ", "plain text", "<p>", "</p></div>", "<" * 50, "<!-- open", "<p class='x>y", "<div>" * 3000 + "deep", "<p>a</p>" * 2000, "<script>only</script>", "<table><tr><td>x<td>y</table>"]
    out = H.extract(odd, model)
    assert out[0] == out[1] == out[2] == "" and out[3] == "plain text"
    df = spark.createDataFrame([(k, None, h) for k, h in enumerate(odd)], "page_id long, text string, html string")
    got = {r.page_id: r.t for r in df.select("page_id", H.main_text(df, model).alias("t")).collect()}
    assert [got[k] for k in range(len(odd))] == out
    assert df.limit(0).select(H.main_text(df, model)).count() == 0


def test_training_is_repeatable(model):
    first, again = (H.train.__wrapped__(100, 3) for _ in range(2))
    assert np.array_equal(first.leaf, again.leaf) and np.array_equal(first.feature, again.feature)
    assert H.train() is model
