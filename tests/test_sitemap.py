"""Sitemap files, odd ones included."""

import random
import time
from xml.etree import ElementTree

from pyspark.sql import functions as F

from pagemill.sources.sitemap import sitemap_locs

_NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
_FILES = [
    (f'<?xml version="1.0"?><urlset {_NS} xmlns:image="i"><url><loc>https://s.org/1?a=1&amp;b=2</loc><image:image>'
     "<image:loc>https://s.org/p.png</image:loc></image:image></url><url/><url><loc/></url><url><loc>https://s.org/2</loc></url></urlset>",
     ["https://s.org/1?a=1&b=2", "https://s.org/2"]),
    (f"<sitemapindex {_NS}><sitemap><loc>https://s.org/a.xml</loc></sitemap></sitemapindex>", ["https://s.org/a.xml"]),
    ("<urlset><url><loc><![CDATA[https://s.org/?x&y]]></loc></url></urlset>", ["https://s.org/?x&y"]),
    ('<s:urlset xmlns:s="n"><s:url><s:loc>https://s.org/3</s:loc></s:url></s:urlset>', ["https://s.org/3"]),
    ("<urlset><loc>https://s.org/6</loc><loc>https://s.org/7</loc></urlset>", ["https://s.org/6", "https://s.org/7"]),
    ("<urlset><url><loc>https://s.org/8</loc><loc>https://s.org/9</loc></url></urlset>", ["https://s.org/8", "https://s.org/9"]),
    (f"<urlset {_NS}><url><loc>https://s.org/4</loc></url><url><loc>", []),
    ("<loc>", []), ("", []), (None, []), ("plain text", []), ("<html><body><p>404</p></body></html>", []),
    ('<!DOCTYPE x [<!ENTITY e "v">]><urlset><url><loc>&e;&unknown;</loc></url></urlset>', None),
    ("<urlset>\x00\x01<url><loc>퟿</loc></url></urlset>", None), ("<a>" * 3000, []), ("<url><loc>x</loc></url>", None),
    ("<urlset><!-- <loc>https://s.org/no</loc> --><loc lang='x'>https://s.org/10</loc><loc /><url><loc>a<b/>c</loc></url></urlset >\n",
     ["https://s.org/10", "a"]),
    ("<urlset><loc>&#233;&#x1F600;&#38;lt;&amp;#65;&#xD800;&#9;&lt;&quot;</loc><loc>x&copy=1</loc></urlset>",
     ["é😀&lt;&#65;&#xD800;\t<\"", "x&copy=1"]),
    ("<urlset><loc>a<![CDATA[&amp;<!-- b -->]]>&amp;<![CDATA[]]>c</loc></urlset>", ["a&amp;<!-- b -->&c"]),
    ("<urlset><loc>a</loc><!-- open</urlset>", []), ("<urlset><loc>a</loc><![CDATA[ open</urlset>", []),
    ("text<urlset><url>text<loc>https://s.org/5</loc></url></urlset>", None), ("<urlset>only text</urlset>", []),
]


def test_locs(spark):
    rows = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(_FILES)], "i int, body string")
    got = {r.i: r.locs for r in rows.select("i", sitemap_locs(F.col("body")).alias("locs")).collect()}
    for i, (body, want) in enumerate(_FILES):
        assert got[i] is not None and (want is None or got[i] == want), body


def test_damaged_files_do_not_fail(spark):
    whole, rng = _FILES[0][0], random.Random(5)
    damaged = []
    for _ in range(300):
        text = list(whole)
        for _ in range(rng.randint(1, 6)):
            text[rng.randrange(len(text))] = rng.choice(["<", ">", "&", '"', "", "]]>", "<!--", "é", "\x0b"])
        damaged.append(("".join(text),))
    rows = spark.createDataFrame(damaged, "body string")
    assert rows.filter(sitemap_locs(F.col("body")).isNotNull()).count() == 300


def test_whole_files_as_an_xml_parser_reads_them(spark):
    rng = random.Random(11)
    pieces = ["https://s.org/a", "&amp;", "&lt;", "&#65;", "&#xe9;", "é", " ", "<![CDATA[&x;]]>", "<!-- c -->", "\n", "?q=1", "]", "-", ">"]
    files = []
    for _ in range(300):
        prefix = rng.choice(["", "", "s:"])
        space = f' xmlns{":s" if prefix else ""}="n" xmlns:i="m"'
        locs = [rng.choice(["{0}loc", "{0}loc", "i:loc", "{0}lastmod"]).format(prefix) for _ in range(rng.randint(0, 5))]
        inner = "".join(f"<{prefix}url><{n}>{''.join(rng.choices(pieces, k=rng.randint(0, 6)))}</{n}></{prefix}url>" for n in locs)
        files.append(f"{rng.choice(['', '<?xml version=\'1.0\'?>'])}<{prefix}urlset{space}>{inner}</{prefix}urlset>".replace("]]]>", "]]>"))
    want = []
    for text in files:
        root = ElementTree.fromstring(text)
        want.append([n.text for n in root.iter(root.tag.replace("urlset", "loc")) if n.text])
    rows = spark.createDataFrame(list(enumerate(files)), "i int, body string").select("i", sitemap_locs(F.col("body")).alias("locs"))
    got = {r.i: r.locs for r in rows.collect()}
    for i, text in enumerate(files):
        assert got[i] == want[i], text


def test_openers_that_never_close_are_read_once(spark):
    bodies = [(f"<urlset>{opener * (500_000 // len(opener))}</urlset>",) for opener in
              ("<!--", "<![CDATA[", "<loc>", "<loc ", "<loc><![CDATA[", "</a ", "</", "<?", "&#", "<loc>&#")]
    rows = spark.createDataFrame(bodies, "body string").select(F.size(sitemap_locs(F.col("body"))).alias("n"))
    began = time.time()
    assert len(rows.collect()) == len(bodies) and time.time() - began < 20
