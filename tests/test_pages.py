from pyspark.sql import functions as F

from pagemill.functions import pages as p
from pagemill.functions import platforms
from pagemill.functions.html_nodes import nodes_or_error, page_nodes, subtree
from pagemill.operators import extract
from pagemill.operators.outcome import page_outcome, site_pages

from test_urls import one

DOC = (
    "<!doctype html><html><head><title>Grid Guide - Lattice 4 manual</title>"
    "<meta name='generator' content='Sphinx 7.2'><meta name='description' content='网格 overview'></head><body>"
    "<nav><ul><li><a href='/toc'>Contents</a></ul></nav><header><p>Banner</p></header><main role='main'>"
    "<h1 id=g>Grid Guide¶</h1><p>A <strong>grid</strong> holds cells; call <code>step()</code> to advance.</p>"
    "<h2>Setting up §</h2><p>Nothing to install.</p>"
    "<pre><code class=python>g = Grid(3)\ng.step()\nprint(g < 4)</code></pre>"
    "<table><tr><th>名称</th><th>值</th></tr><tr><td>rows</td><td>三</td></tr></table>"
    "<ul><li>甲</li><li>乙</li></ul></main><footer>imprint</footer></body></html>")
LINKS = (
    "<html><body><div class='wide document'>\n<h1>Index</h1>\n<ol>\n"
    "  <li><a href='/g'>Guide to the grid and its cells</a></li>\n"
    "  <li><a href='/s'>Stepping</a></li>\n</ol>\n  <p><a href='/q'>Questions asked often</a></p></div></body></html>")


def extracted(spark, html, platform="sphinx"):
    frame = spark.createDataFrame([("https://docs.example.com/x", html, platform)], "url string, html string, platform string")
    return extract.extract_pages(frame).first()


def test_document(spark):
    row = extracted(spark, DOC)
    assert row.markdown == (
        "# Grid Guide\nA **grid** holds cells; call `step()` to advance.\n\n## Setting up\nNothing to install.\n\n"
        "```\ng = Grid(3)\ng.step()\nprint(g < 4)\n```\n\n| 名称 | 值 |\n| --- | --- |\n| rows | 三 |\n\n- 甲\n- 乙")
    assert (row.title, row.raw_title) == ("Grid Guide", "Grid Guide - Lattice 4 manual")
    assert row.meta == {"url": "https://docs.example.com/x", "description": "网格 overview"}
    assert [tuple(t) for t in row.toc] == [(1, "Grid Guide", ""), (2, "Setting up", "")]


def test_link_list_uses_fallback(spark):
    row = extracted(spark, LINKS)
    assert row.markdown == "Index\nGuide to the grid and its cells\nStepping\nQuestions asked often"
    assert row.meta == {"url": "https://docs.example.com/x"} and row.toc == []
    assert extracted(spark, LINKS, "generic").markdown == ""
    assert extracted(spark, LINKS.replace("document", "other")).markdown == ""
    assert extracted(spark, LINKS.replace("Questions asked often", "")).markdown == ""     # under 50 characters


def test_titles(spark):
    cases = {
        "Requests Quickstart - Requests 2.32 docs": "Requests Quickstart", "1. 课前甜点 — Python 3.14.6 文档": "1. 课前甜点",
        "安装 | 配置": "安装 | 配置", "A | B": "A | B", "real-time systems": "real", "- foo": "", "": "", "plain": "plain",
        "API - Something much longer here": "API",
    }
    assert one(spark, cases, p.clean_title(F.col("v"))) == list(cases.values())
    html = {"<TITLE a>\n x <b>y</b> &#8212; z&nbsp;</TITLE><title>no</title>": "x y — z\xa0", "<p>": "",
            "<title>a &amp;lt; b</title>": "a &lt; b"}
    assert one(spark, html, p.page_title(F.col("v"))) == list(html.values())


def test_platforms(spark):
    def generator(name):
        return f'<meta name="generator" content="{name}">'
    cases = {generator("Docusaurus v3"): "docusaurus", generator("Sphinx 8"): "sphinx", generator("jupyter-book 1"): "sphinx",
             generator("hugo") + "theme-doc-x": "hugo", "x theme-doc-y": "docusaurus", '<div class="rst-content">': "readthedocs",
             '<div class="document">': "sphinx", "nothing": "generic", "x" * 4000 + generator("hugo"): "hugo",
             "<body><p>built by readthedocs": "generic", "<link href=//readthedocs.x><body>": "readthedocs",
             '<meta content="hugo" name="generator">': "generic"}
    assert one(spark, cases, platforms.detect_platform(F.col("v"), F.lit("https://a.com"))) == list(cases.values())
    late = ["x" * 4000 + generator("hugo")]
    assert one(spark, late, platforms.detect_platform(F.col("v"), F.lit("https://a.com"), 4000)) == ["generic"]
    rtd = platforms.detect_platform(F.lit(generator("Sphinx")), F.col("v"))
    assert one(spark, ["https://x.RTD.io", "https://a.com"], rtd) == ["readthedocs", "sphinx"]
    assert one(spark, ['<div id="root"></div><script src="app.js"></script>', "<article><p>content</p></article>"],
               platforms.is_shell(F.col("v"))) == [True, False]


def test_outcomes(spark):
    rows = [
        (1, 404, DOC), (2, 200, "  # Plain\ntext \n"), (3, 200, DOC), (4, 200, '<html><div id="root"></div></html>'),
        (5, 200, "<html><body></body></html>"), (6, 200, "  \n"), (7, 200, LINKS),
    ]
    frame = spark.createDataFrame([("s", o, f"https://a.com/d/p{o}.md?x=1.2", s, h, 1.0, "sphinx") for o, s, h in rows],
                                  "site string, ord long, url string, status int, html string, fetched_at double, platform string")
    out = {r.ord: r for r in page_outcome(frame).collect()}
    assert {o: r.error for o, r in out.items()} == {
        1: "HTTP 404", 2: "", 3: "", 4: "empty extraction", 5: "empty extraction", 6: "", 7: ""}
    assert {o for o, r in out.items() if r.needs_render} == {4}
    assert out[2].markdown == "# Plain\ntext" and out[2].title == "p2.md?x=1" and out[2].meta["format"] == "text"
    assert out[2].path == "d/p2" and out[6].markdown == "" and out[1].markdown == "" and out[1].title == ""
    assert out[7].markdown.startswith("Index\n") and out[3].title == "Grid Guide"


def kinds(html):
    return [(n["kind"], n["text"]) for n in page_nodes(html)]


def test_nodes_of_untidy_markup():
    assert kinds("<p>a<p>b <b>c<p>d</b>") == [("para", "a"), ("para", "b **c**"), ("para", "d")]
    assert kinds("bare <i> x </i>text<h2>H</h2>tail") == [("para", "bare *x* text"), ("heading", "H"), ("para", "tail")]
    assert kinds("<script>var t='</p>';</script><!-- <p>x</p> --><p>y &lt;&amp; z") == [("para", "y <& z")]
    assert kinds("<code>a\nb</code><p>x <code>a\nb</code></p>") == [("code", "a\nb"), ("para", "x `a\nb`")]
    assert kinds("<pre>\n x <b>y</b>\n</pre>") == [("code", "\n x y\n")]
    assert kinds("<blockquote>a<br>b<p>c</p></blockquote>d") == [("quote", "a\nb\nc"), ("para", "d")]
    assert kinds("<p><a href='x'><img src=y></a><a>z</a> <del>q</del></p>") == [("para", "[x](x)z ~~q~~")]
    assert kinds("1 < 2 <p>x") == [("para", "1 < 2"), ("para", "x")]
    assert kinds("<nav>n<nav>m</nav>o</nav><aside>p</aside>q") == [("para", "q")]
    assert kinds("<main><header><h1>T</h1></header></main><header>x</header>") == [("heading", "T")]


def test_link_only_blocks_hold_no_prose(spark):
    def prose(html):
        frame = spark.createDataFrame([("u", html)], "url string, html string")
        return len(extract.content_nodes(frame).first().nodes) > 0
    for link in ("<a href='/x_(y)'>a b</a>", "<b><a href=u><i>x</i> y</a></b>", "<a href=u></a>", "<a>x</a>", "<ul><li><a href=u>x</a></ul>"):
        assert not prose(f"<h1>T</h1><p>{link}</p>"), link
        assert prose(f"<h1>T</h1><p>{link} more</p>"), link
    assert prose("<pre>x</pre>") and prose("<p><code>x</code>") and not prose("<h1>only</h1>")


def test_nodes_of_lists_and_tables():
    nodes = page_nodes("<ol><li>a<ul><li>b</ul><li>c</ol><ul><li>d</ul>")
    assert [(n["text"], n["level"], n["ordinal"], n["list_no"]) for n in nodes] == [
        ("a", 0, 1, 1), ("b", 1, 0, 1), ("c", 0, 2, 1), ("d", 0, 0, 2)]
    table, after = page_nodes("<table><tr><td>a<td>b<p>c</p><tr><td><b>d</table>e")
    assert table["rows"] == [["a", "b\nc"], ["**d**"]] and after["text"] == "e"
    assert page_nodes("<table><tr><td>x<table><tr><td>y</table>z</td></tr></table>")[0]["rows"] == [["x y z"]]


def test_selectors():
    html = "<div class='a book-body'><p><section class='page-inner x'>S<section>T</section></section>U</div><main>M</main>"
    assert subtree(html, ".book-body .page-inner") == "<section class='page-inner x'>S<section>T</section></section>"
    assert subtree(html, "main") == "<main>M</main>" and subtree(html, "div.x") is None
    assert subtree("<p role=\"main\">x", "[role='main']") == "<p role=\"main\">x"


def test_table_cells(spark):
    frame = spark.createDataFrame([([["a|b", " c\n d "], ["e"], ["f", "g", "h"]],)], "rows array<array<string>>")
    assert frame.select(extract.table_markdown(F.col("rows"))).first()[0] == (
        "| a\\|b | c d |  |\n| --- | --- | --- |\n| e |  |  |\n| f | g | h |")


def test_unreadable_page_fails_alone(spark):
    node, = nodes_or_error(b"bytes")
    assert node["kind"] == "error" and node["text"].startswith("TypeError: ")
    error = p.outcome_error(F.lit(200), F.lit(True), F.lit(""), F.lit(node["text"]))
    assert one(spark, ["x"], error) == [node["text"]]


def test_html_behind_comments(spark):
    cases = {"<!-- " + "x" * 600 + " -->\n<?xml version='1.0'?> <html>": True, "\ufeff <!DOCTYPE html>": True, "x" * 505 + "<head>": True,
             "x" * 600 + "<html>": False, "# Pages\n" + "y" * 600 + "\n```\n<!doctype html>\n```": False, "": False}
    assert one(spark, cases, p.is_html(F.col("v"))) == list(cases.values())


def test_descriptions_are_whole(spark):
    html = ['<meta name="description" content="' + "d" * 700 + '">']
    assert one(spark, html, p.description(F.col("v"))) == ["d" * 700]
    assert one(spark, html, p.description(F.col("v"), 300)) == ["d" * 300]


def test_pages_of_several_sites_are_parsed_once(spark):
    html = "<html><head><title>T</title></head><body><main><p>Some prose here.</p></main></body></html>"
    stored = spark.createDataFrame([("https://a.com/x", 200, html, 1.0), ("https://a.com/y", 404, "", 2.0), ("https://a.com/z", 200, html, 3.0)],
                                   "url string, status int, html string, fetched_at double")
    wanted = [(s, o, f"https://a.com/{u}", p) for s, o, u, p in
              (("s", 1, "x", "generic"), ("t", 7, "x", "generic"), ("u", 2, "x", "sphinx"), ("t", 8, "y", "generic"), ("t", 9, "new", "generic"))]
    wanted = spark.createDataFrame(wanted, "site string, ord bigint, url string, platform string")
    got = site_pages(stored, wanted)
    each = page_outcome(stored.join(wanted, "url"))
    assert sorted(map(str, got.collect())) == sorted(map(str, each.collect())) and got.count() == 4 and got.columns == each.columns
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate inline") < plan.index("ArrowEvalPython")     # dealt to the sites above the parser
