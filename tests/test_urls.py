import fnmatch
from urllib.parse import urljoin, urlsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.config import SiteConfig, load_sites, sites_frame
from pagemill.functions import filters, urls
from pagemill.functions.text import SPACE_CHARS, glob_regex, strip


def values(spark, rows, schema, **columns):
    """Evaluate columns over rows; one tuple per row."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    out = frame.select("i", *[c.alias(n) for n, c in columns.items()]).collect()
    return [tuple(r)[1:] for r in sorted(out)]


def one(spark, items, column):
    return [r[0] for r in values(spark, [(x,) for x in items], "v string", out=column)]


def test_normalize_cases(spark):
    cases = {
        "https://Wiki.Example.org:443/guide/index.htm": "https://wiki.example.org/guide",
        "http://wiki.example.org/guide/part-2//": "http://wiki.example.org/guide/part-2",
        "https://wiki.example.org/g?utm=7&version=3&page=2#top": "https://wiki.example.org/g?version=3",
        "gopher://wiki.example.org/g": None, "https://wiki.example.org:8443/": "https://wiki.example.org:8443/",
        "http://a.com:80": "http://a.com/", "http://a.com:443/": "http://a.com:443/",
        "https://a.com///": "https://a.com/", "https://a.com/Index.html": "https://a.com/Index.html",
        "https://a.com/x/index.md/": "https://a.com/x/index.md", "HTTPS://User@A.com/x": "https://user@a.com/x",
        "https://a.com/?lang=&version=2&hl=a=b&xhl=1": "https://a.com/?version=2&hl=a=b",
        "　https://a.com/a\tb\n": "https://a.com/ab", "https:///x": None, "//a.com/x": None, "": None,
        "https://[::1/x": None, "https://[::1]/x": "https://[::1]/x", "https://a.com？/x": None,
        "https://www.a.com/a b|c": "https://www.a.com/a b|c",
    }
    assert one(spark, cases, urls.normalize_url(F.col("v"))) == list(cases.values())


def test_normalize_is_idempotent(spark):
    seen = [f"https://H.com/{p}{q}" for p in ("", "a/", "a//b/", "index.html", "x/index.htm") for q in ("", "?hl=1&a=2", "#f")]
    first = one(spark, seen, urls.normalize_url(F.col("v")))
    assert one(spark, first, urls.normalize_url(F.col("v"))) == first


HREFS = ["", "x", "./x", "../x", "../../../x", "x/../y", "/x", "/x/../y/.", "/a//b", "x//y", "?q=1", "#f", "x#f", "//h/x",
         "//h", "http://h/x", "https://h/a/../b", "mailto:a@b", "javascript:void(0)", ".", "..", "./", "../", "x/.", "x/..",
         "é/ü", "a b", "x?y=/../z", "/..", "/../..", "HTTPS://H/x", "x:y", "%2e%2e/x"]
BASES = ["https://a.com", "https://a.com/", "https://a.com/d/e", "https://a.com/d/e/", "https://a.com/d//e/f?q=1#z"]


def test_resolve_matches_urljoin(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    got = values(spark, rows, "b string, h string", out=urls.resolve_url(F.col("b"), F.col("h")))
    assert [g[0] for g in got] == [urljoin(b, h) for b, h in rows]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="./ab?#:", max_size=12), min_size=20, max_size=40))
def test_resolve_matches_urljoin_on_random_hrefs(spark, hrefs):
    def clean(url):     # an empty fragment or query mark and parameters carry no information here
        return url.rstrip("#?")
    got = one(spark, hrefs, urls.resolve_url(F.lit("https://a.com/d/e"), F.col("v")))
    for href, result in zip(hrefs, got):
        if "#" not in href and not href.startswith("//") and "//" not in href:
            assert clean(result) == clean(urljoin("https://a.com/d/e", href)), href


def test_parts_match_urlsplit(spark):
    cases = [urljoin(b, h) for b in BASES for h in HREFS] + ["1http://x", "a:b", "//h?x", "h/p#q?r"]
    p = urls.url_parts(F.col("v"))
    got = values(spark, [(c,) for c in cases], "v string", s=p.scheme, n=p.netloc, p=p.path, q=p.query)
    assert got == [tuple(urlsplit(c))[:4] for c in cases]


def test_ext(spark):
    cases = {"https://a.com/x.PDF": ".pdf", "https://a.com/a.b/c": "", "https://a.com/x.tar.gz": ".gz",
             "https://a.com/x.": ".", "https://a.com": "", "https://a.com/x?y=z.pdf": ""}
    assert one(spark, cases, urls.url_ext(F.col("v"))) == list(cases.values())


def test_rel_path_fixture(spark):
    cases = {
        "/": "index", "/docs/intro/": "docs/intro", "/docs/x/index.html": "docs/x", "/docs/x.html": "docs/x",
        "/docs/a.md": "docs/a", "/docs/CON": "docs/_CON", "/a/b?hl=zh": "a/b",
        "/index.html": "index", "/index": "index", "/a/index.htm": "a", "/a/index.htm.html": "a", "/a/INDEX": "a",
        "/a//b": "a/b", "/a:b*c": "a_b_c", "/ . /x": "index/x", "/a. ./x": "a/x", "/lpt9/com0": "_lpt9/com0",
        "/" + "é" * 200: "é" * 200, "/con.txt": "_con", "/nul.x": "nul.x",
    }
    got = one(spark, [f"https://a.com{c}" for c in cases], urls.rel_path(F.col("v")))
    assert dict(zip(cases, got)) == cases


def test_candidate_cases(spark):
    base, origin, prefix = "https://manual.example.net/v4/", "manual.example.net", "/v4"
    cases = {
        "cells/grow.html": "https://manual.example.net/v4/cells/grow.html", "/": None, "https://elsewhere.example/v4/a": None,
        "https://manual.example.net/v3/cells": None, "https://manual.example.net/v4/cells/": "https://manual.example.net/v4/cells",
        "//manual.example.net/v3": "https://manual.example.net/v3", "\t../faq ": "https://manual.example.net/faq",
        "HTTPS://manual.example.net/y": "https://manual.example.net/y",
    }
    got = one(spark, cases, filters.candidate_from_href(F.col("v"), F.lit(base), F.lit(origin), F.lit(prefix)))
    assert dict(zip(cases, got)) == cases


def test_paths_that_pass(spark):
    exclude = F.lit(glob_regex(["/handbook/drafts/*", "*/v?-beta"]))
    def keep(allow_md):
        return filters.path_passes(F.col("v"), F.lit("generic"), F.lit(None).cast("string"), exclude, allow_md)
    cases = {"/handbook/soil": True, "/handbook/drafts": True, "/handbook/drafts/soil": False, "/handbook/v2-beta": False,
             "/handbook/soil.svg": False, "/handbook/soil.html": True, "/handbook/searching": False, "/feedback": False,
             "/handbook/soil.markdown": True, "/handbook/soil.md": False, "/handbook/tags": True, "/tags": False, "": True}
    assert one(spark, cases, keep(False)) == list(cases.values())
    assert one(spark, ["/handbook/soil.md", "/handbook/drafts/soil.md"], keep(True)) == [True, False]


def test_globs_match_fnmatch(spark):
    patterns = ["/docs/*", "*.md", "/a?c", "/[ab]*", "/[!ab]*", "/x[", "/x[]]", "/[a-c]/**", "/a.b+c", "/[^a]", "*"]
    paths = ["/docs/", "/docs/a/b", "/x.md", "/abc", "/b", "/c/d", "/x[", "/x]", "/a.b+c", "/a", "/^", "/é\n"]
    for pattern in patterns:
        want = [fnmatch.fnmatchcase(p, pattern) for p in paths]
        assert one(spark, paths, F.col("v").rlike(glob_regex([pattern]))) == want, pattern


def test_exclusion_beats_inclusion(spark):
    include, exclude = F.lit(glob_regex(["/tools/*", "/[a-c]*"])), F.lit(glob_regex(["/tools/old?"]))
    cases = {"/tools/saw": True, "/tools/old1": False, "/tools/old12": True, "/tools": False, "/bench": True, "/drill": False,
             "/categories": False}
    assert one(spark, cases, filters.path_allowed(F.col("v"), include, exclude)) == list(cases.values())


def test_strip_is_python_strip(spark):
    cases = [f"{c}a{c}b{c}" for c in SPACE_CHARS] + ["", " ", "﻿x"]
    assert one(spark, cases, strip(F.col("v"))) == [c.strip() for c in cases]


def test_site_settings(spark, tmp_path):
    for formats in (["epub"], ["md", "MD?"]):
        with pytest.raises(ValueError):
            SiteConfig("https://garden.example", formats=formats)
    everything = SiteConfig("https://garden.example", formats=["all"])
    assert everything.formats == ["md", "json", "jsonl", "pdf"]
    assert SiteConfig("https://garden.example:9000/en/").site_name == "garden.example_9000"
    assert SiteConfig("https://garden.example/en/", name="plants").site_name == "plants"
    good, bad = tmp_path / "two.json", tmp_path / "none.json"
    good.write_text('{"sites": [{"url": "https://garden.example/en", "formats": ["json"], "include": ["/en/*"], "max_pages": 7},'
                    ' {"url": "https://tools.example"}]}')
    bad.write_text('{"pages": []}')
    rows = {r.site: r for r in sites_frame(spark, load_sites(good)).collect()}
    assert sorted(rows) == ["garden.example", "tools.example"]
    assert rows["garden.example"].formats == ["json"] and rows["garden.example"].max_pages == 7
    assert rows["garden.example"].include_re == glob_regex(["/en/*"]) and rows["tools.example"].include_re is None
    with pytest.raises(ValueError):
        load_sites(bad)
    name = urls.site_name(F.lit(None).cast("string"), F.col("v"))
    cases = ["https://garden.example:80/x", "tools.example/y", "https://garden.example"]
    assert one(spark, cases, name) == [SiteConfig(c).site_name for c in cases]
