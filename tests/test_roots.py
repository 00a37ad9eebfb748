"""Content roots and noise: nothing of a page is lost to nesting, forms or unclosed elements."""

import time

import pytest

from pagemill.functions.html_nodes import page_nodes
from pagemill.operators.extract import content_nodes, root_nodes, settled_nodes
from pyspark.sql import functions as F
from pagemill.operators.links import extract_links
from pagemill.sources.resources import upsert


@pytest.mark.parametrize("html,kept", [
    ('<div role="main"><p>a</p><div class="x"><pre>b</pre></div><p>c</p><h2>d</h2></div><p>out</p>', ["a", "b", "c", "d"]),
    ("<article><article><p>a</p></article><p>b</p></article><p>out</p>", ["a", "b"]),
    ("<form><article><p>a</p></article></form>", ["a"]),
    ("<nav><a>x</a><article><p>a</p></article>", ["a"]),
    ("<div role=main><p>a</p><nav><div>menu</div></div><p>out</p>", ["a"]),
])
def test_roots(spark, html, kept):
    frame = spark.createDataFrame([(html,)], "html string")
    assert [n.text.strip() for n in content_nodes(frame).first().nodes] == kept


def test_a_form_is_no_noise_and_a_parent_closes_noise(spark):
    assert [n["text"] for n in page_nodes("<form><p>inside</p></form>")] == ["inside"]
    frame = spark.createDataFrame([("<div role=main><nav><p>menu</p></div><p>after</p>",)], "html string")
    assert [n.text for n in content_nodes(frame).first().nodes] == ["after"]


LONG, NEXT = "A first paragraph that has some words.", "Another paragraph, about as long as that."
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Guides and more</a></li></ul>'


@pytest.mark.parametrize("html,kept", [
    (f"<html><head><title>t</title><p>{LONG}", [LONG]),
    (f"<html><title>t</title><p>{LONG}", [LONG]),
    (f"<html><head><title>t<p>{LONG}", [LONG]),
    (f"<html><head><meta charset=x> {LONG}<p>{NEXT}", [LONG, NEXT]),
    (f"<html><body>{MENU}<div><h1>T</h1><p>{LONG}</p><p>{NEXT}</p></div></body>", ["T", LONG, NEXT]),
    (f"<div>{MENU}</div><div><p>{LONG}", [LONG]),
    (f"<p>{LONG}</p><select><option>one<option>two<p>{NEXT}</p>", [LONG, NEXT]),
    (f"<button>Go<p>{LONG}</p>", [LONG]),
    (f"<main><p>{LONG}</p><aside><p>{NEXT}</p><p>{LONG}</p></main><p>out</p>", [LONG, NEXT, LONG]),
    (f"{MENU}<main><p>{LONG}</p></main>", [LONG]),
    (f"<p>Press <button>OK</button> now, {LONG}</p>", [f"Press now, {LONG}"]),
    (f"<pre><button>copy</button>x = 1</pre><p>{LONG}</p>", ["x = 1", LONG]),
    (f"<div><table><tr><td><nav></div>a</td><td>b</td></tr></table><p>{LONG}</p></div>", ["a\tb", LONG]),
    (f'<p class="a"">{LONG}</p><p title=it\'s>{NEXT}</p>', [LONG, NEXT]),
    ("<nav><p>only a menu</p></nav>", []),
])
def test_noise_without_end_tags(spark, html, kept):
    """Nothing but navigation is lost to elements that were never closed."""
    frame = spark.createDataFrame([(html,)], "html string")
    assert [n.text.strip() for n in content_nodes(frame).first().nodes] == kept


@pytest.mark.parametrize("html,kept", [
    (f"<html><body>{MENU}<div><h1>T</h1>{'<p>At ha.</p>' * 3}<p>At</p></div></body>", ["T", "At ha.", "At ha.", "At ha.", "At"]),
    (f"<html><body>{MENU}<div><h1>T</h1><p>At</p></div></body>", ["T", "At"]),
    ("<main><aside><h1>T</h1><p>At</p></main><p>out</p>", ["T", "At"]),
    (f"<body><nav><h2>Menu</h2><ul>{MENU[9:]}<p>v2</p><ul>{MENU[9:]}<p>{LONG}</p></body>", [LONG]),
])
def test_short_text_behind_an_open_menu_stays(spark, html, kept):
    """A short block goes with its run of text where no links follow it."""
    frame = spark.createDataFrame([(html,)], "html string")
    assert [n.text.strip() for n in content_nodes(frame).first().nodes] == kept


def test_links_between_text_stay(spark):
    html = f'<aside><p>{LONG}</p><p><a href="/x">See the other page on this</a></p><p>{NEXT}</p><ul>{MENU[9:]}'
    nodes = spark.createDataFrame([(page_nodes(html),)], "nodes array<struct<kind:string,level:int,ordinal:int,list_no:int,"
                                  "in_root:boolean,unsure:boolean,text:string,linked:int,rows:array<array<string>>>>")
    kept = nodes.select(root_nodes(settled_nodes(F.col("nodes"))).alias("n")).first().n
    assert [n.text for n in kept] == [LONG, "[See the other page on this](/x)", NEXT]


@pytest.mark.parametrize("opener", ["<a ", "<script", "<script ", "<!", "<!--", "<a<", '<a x="', "<nav>", "<td><nav></div>", "<main>", "<div><nav>"])
def test_unclosed_tags_take_linear_time(opener):
    began = time.perf_counter()
    page_nodes(opener * (1_000_000 // len(opener)))
    assert time.perf_counter() - began < 2


@pytest.mark.parametrize("opener", ["<!-- ", "<script>", "<style>", "<a "])
def test_links_of_unclosed_tags_take_linear_time(spark, opener):
    page = '<a href="/x">x</a>' + opener * 40_000
    frame = spark.createDataFrame([("https://a.com/", page)], "url string, html string")
    began = time.perf_counter()
    assert [r.href for r in extract_links(frame).collect()] == ["/x"]
    assert time.perf_counter() - began < 10


def test_upsert_with_unknown_times(spark):
    schema = "url string, status int, html string, fetched_at double"
    stored = spark.createDataFrame([("a", 200, "old", None), ("b", 200, "old", 5.0)], schema)
    came = spark.createDataFrame([("a", 200, "new", None), ("b", 200, "new", None)], schema)
    assert sorted((r.url, r.html) for r in upsert(stored, came).collect()) == [("a", "new"), ("b", "old")]


def test_upsert_of_tied_times(spark):
    schema = "url string, status int, html string, fetched_at double"
    stored = spark.createDataFrame([("a", 200, "old", 1.0), ("b", 200, "keep", 9.0), ("z", 200, "z", None)], schema)
    came = spark.createDataFrame([("a", 200, "x", 1.0), ("a", 200, "y", 1.0), ("a", 200, "z", 0.0), ("b", 200, "late", 2.0), ("c", 200, "c", 1.0),
                                  ("c", 200, "c", 1.0), ("d", 200, "p", None), ("d", 200, "q", None), ("e", 500, "no", 3.0)], schema)
    got = sorted((r.url, r.html, r.fetched_at) for r in upsert(stored, came).collect())
    assert got == [("a", "y", 1.0), ("b", "keep", 9.0), ("c", "c", 1.0), ("d", "q", None), ("z", "z", None)]
