import random
from collections import deque

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.config import SiteConfig, sites_frame
from pagemill.operators import discovery, frontier, reports
from pagemill.operators.links import extract_links, link_graph
from pagemill.operators.ranking import rank_in_group, top_n
from pagemill.session import bucketed, small_side, spread
from pagemill.sources.resources import scan_pages, upsert

RULES = ("site string, url string, platform string, include_re string, exclude_re string, max_depth int, max_pages int, "
         "adapter string")


def site_rows(spark, *sites):
    rows = [(name, url, "generic", None, None, depth, pages, adapter) for name, url, depth, pages, adapter in sites]
    return spark.createDataFrame(rows, RULES)


def pages_of(spark, graph):
    html = {u: "".join(f'<a href="{h}">x</a>' for h in hrefs) for u, hrefs in graph.items()}
    return spark.createDataFrame([(u, 200, h) for u, h in html.items()], "url string, status int, html string")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def queue_crawl(graph, start, max_depth, max_pages):
    """Breadth-first order with a plain queue."""
    order, seen, queue = [], set(), deque([(start, 0)])
    while queue:
        url, depth = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        if max_pages and len(order) >= max_pages:
            break
        order.append((url, depth))
        if not max_depth or depth < max_depth:
            queue.extend((u, depth + 1) for u in graph.get(url, []) if u not in seen)
    return order


def random_graph(seed, nodes, links):
    rng = random.Random(seed)
    name = [f"https://a.com/n{i}" for i in range(nodes)]
    return {u: [rng.choice(name) for _ in range(rng.randrange(links))] for u in name[: nodes * 3 // 4]}


@pytest.mark.parametrize("seed", [1, 2])
def test_crawl_is_breadth_first(spark, seed):
    graph = random_graph(seed, 60, 6)
    start = next(u for u, links in graph.items() if len(set(links)) > 2)
    limits = {"all": (0, 0), "deep2": (2, 0), "cap9": (0, 9), "both": (3, 20), "one": (0, 1)}
    sites = site_rows(spark, *((n, "https://a.com/", d, p, "auto") for n, (d, p) in limits.items())).withColumn("url", F.lit(start))
    # the start path is a prefix for links written absolute, so write them relative to the host
    hrefs = {u: [x.removeprefix("https://a.com") for x in links] for u, links in graph.items()}
    got = discovery.crawl_graph(sites, link_graph(pages_of(spark, hrefs))).collect()
    assert all((r.rank is None) == (limits[r.site][1] == 0) for r in got if r.depth)
    for name, (depth, cap) in limits.items():
        mine = [(r.url, r.depth) for r in sorted((r for r in got if r.site == name), key=lambda r: (r.depth, r.rank or 0, r.url))]
        want = queue_crawl(graph, start, depth, cap)
        assert mine == (want if cap else sorted(want, key=lambda x: (x[1], x[0]))), name
    free = discovery.crawl_graph(sites.filter("max_pages = 0"), link_graph(pages_of(spark, hrefs)))
    assert sorted(r.url for r in free.filter("site = 'all'").collect()) == sorted(u for u, _ in queue_crawl(graph, start, 0, 0))


def test_crawl_rules(spark):
    graph = {"https://a.com/docs": ["/docs/a", "/", "b", "https://a.com/other", "https://a.com/docs2", "/x.pdf", "//b.com/docs/y",
                                    "/docs/missing", "/search"],
             "https://a.com/docs/a": ["/docs/deep"], "https://a.com/search": ["/docs"]}
    sites = site_rows(spark, ("s", "https://a.com/docs/", 0, 0, "auto"), ("bad", "https://a.com/search", 0, 0, "auto"))
    got = discovery.crawl_graph(sites, link_graph(pages_of(spark, graph))).collect()
    assert sorted((r.site, r.url.removeprefix("https://a.com"), r.depth) for r in got) == [
        ("s", "/b", 1), ("s", "/docs", 0), ("s", "/docs/a", 1), ("s", "/docs/deep", 2), ("s", "/docs/missing", 1), ("s", "/docs2", 1)]


def test_graph_join_moves_only_the_frontier(spark):
    links = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("src_url"), F.col("id").alias("pos"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with bucketed(links, "src_url", "graph") as graph:
            joined = spark.createDataFrame([("u5",)], "src_url string").join(graph, "src_url")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            assert joined.count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_crawl_levels_broadcast_only_rules(spark, monkeypatch):
    """With the bound at no rows, neither the graph nor the URLs met so far are broadcast, and the crawl is the same."""
    graph = {f"https://h.example/p/{i}": [f"/p/{2 * i + 1}", f"/p/{2 * i + 2}", f"/p/{i // 3}"] for i in range(30)}
    sites = site_rows(spark, ("a", "https://h.example/p/0", 0, 0, "auto"), ("b", "https://h.example/p/2", 3, 0, "auto"))
    links = link_graph(pages_of(spark, graph))
    want = sorted(discovery.crawl_graph(sites, links).collect())
    plans, following = [], discovery._next_level

    def recorded(*args):
        level = following(*args)
        plans.append(plan_of(level))
        return level
    monkeypatch.setattr(discovery, "LEVEL_ROWS", 0, raising=False)
    monkeypatch.setattr(discovery, "_next_level", recorded)
    assert sorted(discovery.crawl_graph(sites, links).collect()) == want and len(want) > 60
    assert plans and all(plan.count("BroadcastHashJoin") == 1 for plan in plans)


def test_crawl_levels_check_paths_of_reached_links_only(spark, monkeypatch):
    """No level may run the path patterns over the whole graph, which Catalyst does with any filter it can push below a join."""
    graph = {"https://h.example/p/0": ["/p/1", "/search", "/p/x.pdf"], "https://h.example/p/1": ["/p/2", "/p/0"]}
    plans, following = [], discovery._next_level

    def recorded(*args):
        level = following(*args)
        plans.append(plan_of(level))
        return level
    monkeypatch.setattr(discovery, "_next_level", recorded)
    got = discovery.crawl_graph(site_rows(spark, ("a", "https://h.example/p/0", 0, 0, "auto")), link_graph(pages_of(spark, graph)))
    assert sorted((r.url[-1], r.depth) for r in got.collect()) == [("0", 0), ("1", 1), ("2", 2)]
    assert plans and not any("RLIKE" in line.upper() for plan in plans for line in plan.splitlines() if "Filter" in line)


def test_buckets_are_one_file_each(spark):
    links = spark.range(0, 1000, 1, 6).select(F.concat(F.lit("u"), "id").alias("src_url"), F.col("id").alias("pos"))
    with bucketed(links, "src_url", "graph") as graph:
        assert graph.count() == 1000 and len(graph.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_link_patterns_run_once(spark):
    found = extract_links(pages_of(spark, {"https://a.com/": ["/x?a=1&amp;b=2", "/y"]}))
    assert plan_of(found).count("regexp_extract_all(") == 1
    assert [r.href for r in found.orderBy("pos").collect()] == ["/x?a=1&b=2", "/y"]


def test_sites_without_files_are_crawled_at_once(spark, monkeypatch):
    """Where nothing stored is an llms.txt, robots.txt or sitemap, the steps that read those do not run."""
    sites = site_rows(spark, ("s", "https://a.com/", 0, 0, "auto"), ("t", "https://a.com/b", 0, 0, "llmstxt"))
    pages = pages_of(spark, {"https://a.com/": ["/b", "/c"]})
    want = sorted(map(tuple, discovery.crawl_urls(sites.filter("site = 's'"), link_graph(pages)).collect()))
    monkeypatch.setattr(discovery, "llms_urls", None)
    monkeypatch.setattr(discovery, "sitemap_urls", None)
    urls, full = discovery.discover(sites, pages)
    assert sorted(map(tuple, urls.select("site", "ord", "url").collect())) == want and len(want) == 3
    assert {r.source for r in urls.collect()} == {"bfs"} and full.columns == ["site", "url", "text"] and full.isEmpty()


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    spark.range(0, 20_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        table = spark.read.parquet(str(tmp_path / "t"))
        assert table.rdd.getNumPartitions() >= 4
        counts = [r["count"] for r in spread(table).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == 20_000 and max(counts) * 4 <= 2 * 20_000
        even = table.repartition(8)
        assert spread(even).rdd.getNumPartitions() == 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_links_of_odd_markup(spark):
    html = ("<a href='/1'>x</a><A class=y HREF = /2>z</A><!-- <a href='/no'> --><script>'<a href=\"/no\">'</script>"
            "<a data-href='/no' href=\"/3?a=1&amp;b=&#50;\"><area href=/no><abbr href=/no><a name=x><a\nhref=''>e")
    frame = spark.createDataFrame([("https://a.com", html)], "url string, html string")
    assert [r.href for r in extract_links(frame).orderBy("pos").collect()] == ["/1", "/2", "/3?a=1&b=2", ""]
    html = ("""<a title="p>q" href="/4">x</a><a title="not href='/no' here" href=/5 rel=x>y</a><a class="k"href='/6'>z</a>"""
            """<a hidden href = "/7"><a/href=/8><a download title='<b' href="/9?x='1'"><a title="/no" <a href="/10">""")
    frame = spark.createDataFrame([("https://a.com", html)], "url string, html string")
    assert [r.href for r in extract_links(frame).orderBy("pos").collect()] == ["/4", "/5", "/6", "/7", "/8", "/9?x='1'", "/10"]


def test_links_of_a_redirected_page(spark):
    rows = [("https://a.com/old", "https://a.com/new/", 200, "<a href='x'>x</a>"), ("https://a.com/d/e", None, 200, "<a href='x'>x</a>")]
    graph = link_graph(spark.createDataFrame(rows, "url string, final_url string, status int, html string"))
    assert sorted((r.src_url, r.dst_url) for r in graph.collect()) == [
        ("https://a.com/d/e", "https://a.com/d/x"), ("https://a.com/old", "https://a.com/new/x")]


def test_platform_of_a_start_page_stored_under_its_canonical_url(spark):
    head = "<html><head>" + "<!-- x -->" * 600 + '<meta name="generator" content="{}">'
    stored = spark.createDataFrame([("https://rtd.org/en", 200, head.format("Sphinx")), ("https://b.org/d/", 200, head.format("Hugo")),
                                    ("https://b.org/d", 200, head.format("GitBook"))], "url string, status int, html string")
    sites = site_rows(spark, ("r", "https://rtd.org/en/", 0, 0, "auto"), ("b", "https://b.org/d/", 0, 0, "auto"),
                      ("none", "https://c.org/", 0, 0, "auto"), ("own", "https://b.org/d/", 0, 0, "vuepress")).drop("platform")
    assert {r.site: r.platform for r in discovery.site_platform(sites, stored).collect()} == {
        "r": "readthedocs", "b": "hugo", "none": "generic", "own": "vuepress"}


def sitemap(*locs):
    body = "".join(f"<url><loc>{loc}</loc></url>" for loc in locs)
    return f'<?xml version="1.0"?><urlset xmlns="http://x">{body}</urlset>'


def walk(files, url, guard, out, depth=0):
    """Depth-first sitemap walk over ``{url: locs}``."""
    if depth > 3 or len(out) > guard or url not in files:
        return
    children = [u for u in files[url] if "sitemap" in u.lower() and u.lower().endswith(".xml")]
    for child in children[:60]:
        walk(files, child, guard, out, depth + 1)
    out.extend(u for u in files[url] if not u.endswith(".xml"))


@pytest.mark.parametrize("guard", [0, 3, 7, 100_000])
def test_sitemap_order_and_guard(spark, guard):
    host = "https://a.com"
    files = {f"{host}/sitemap.xml": [f"{host}/sitemap-{i}.xml" for i in range(3)] + [f"{host}/root{i}" for i in range(4)]}
    for i in range(3):
        files[f"{host}/sitemap-{i}.xml"] = [f"{host}/p{i}a", f"{host}/sitemap-{i}-x.xml", f"{host}/p{i}b"]
        files[f"{host}/sitemap-{i}-x.xml"] = [f"{host}/sitemap.xml", f"{host}/q{i}"]
    files[f"{host}/other.xml"] = [f"{host}/last"]
    resources = spark.createDataFrame(
        [(u, 200, sitemap(*locs)) for u, locs in files.items()] + [(f"{host}/broken.xml", 200, "<loc>")],
        "url string, status int, html string")
    candidates = spark.createDataFrame([("s", 0, f"{host}/sitemap.xml"), ("s", 1, f"{host}/broken.xml"), ("s", 2, f"{host}/other.xml")],
                                       "site string, ord int, url string")
    sites = site_rows(spark, ("s", f"{host}/", 0, 0, "auto"))
    got = discovery.sitemap_tree(candidates, sites, resources, guard, 60, 3).orderBy("ord").collect()
    want = []
    for u in (f"{host}/sitemap.xml", f"{host}/other.xml"):
        walk(files, u, guard, want)
    assert [r.url for r in got] == want
    # without limits every file is read once, although one leads back to the first
    free = discovery.sitemap_tree(candidates, sites, resources).collect()
    assert sorted(r.url for r in free) == sorted(u for locs in files.values() for u in locs if not u.endswith(".xml"))


def test_sitemap_children_are_capped(spark):
    host = "https://a.com"
    files = {f"{host}/sitemap.xml": [f"{host}/sitemap{i}.xml" for i in range(70)]}
    files |= {f"{host}/sitemap{i}.xml": [f"{host}/p{i}"] for i in range(70)}
    resources = spark.createDataFrame([(u, 200, sitemap(*locs)) for u, locs in files.items()], "url string, status int, html string")
    candidates = spark.createDataFrame([("s", 0, f"{host}/sitemap.xml")], "site string, ord int, url string")
    for children, count in ((60, 60), (None, 70)):
        got = discovery.sitemap_tree(candidates, site_rows(spark, ("s", host, 0, 0, "auto")), resources, children=children)
        assert [r.url for r in got.orderBy("ord").collect()] == [f"{host}/p{i}" for i in range(count)]


def test_wide_sides_are_merged_however_well_they_compress(spark):
    wide = small_side(spark.range(30_000).select(F.lit("a").alias("k"), "id"), "wide", 20_000)
    assert "SortMergeJoin" in plan_of(spark.createDataFrame([("a",)], "k string").join(wide, "k"))


def test_sitemap_levels_broadcast_no_long_list(spark, monkeypatch):
    """Every file names the next two: with the bound at no rows, no level's join is broadcast and the result is the same."""
    def loc(i):
        return f"<sitemap><loc>https://h.example/sitemap-{i}.xml</loc></sitemap><url><loc>https://h.example/p{i}</loc></url>"
    files = spark.createDataFrame([(f"https://h.example/sitemap-{i}.xml", 200, f"<urlset>{loc(i + 1)}{loc(i + 2)}</urlset>")
                                   for i in range(6)], "url string, status int, html string")
    candidates = files.select(F.concat(F.lit("s"), F.regexp_extract("url", r"(\d+)", 1)).alias("site"), F.lit(0).alias("ord"), "url")
    sites = site_rows(spark, *((f"s{i}", "https://h.example/", 0, 0, "auto") for i in range(6)))
    want = sorted(discovery.sitemap_tree(candidates, sites, files).collect())
    plans, write = [], discovery.written

    def recorded(df, name):
        plans.extend([plan_of(df)] if name == "level" else [])
        return write(df, name)
    monkeypatch.setattr(discovery, "LEVEL_ROWS", 0, raising=False)
    monkeypatch.setattr(discovery, "written", recorded)
    assert sorted(discovery.sitemap_tree(candidates, sites, files).collect()) == want and len(want) > 20
    assert len(plans) > 3 and not any("BroadcastHashJoin" in plan for plan in plans[1:])


def test_subtree_and_expansion(spark):
    sites = site_rows(spark, ("under", "https://a.com/d/", 0, 0, "auto"), ("above", "https://a.com/d/x/y", 0, 0, "auto"),
                      ("apart", "https://a.com/z/", 0, 0, "auto"), ("root", "https://a.com/", 0, 0, "auto"))
    urls = [f"https://a.com{p}" for p in ("/d/x", "/d", "/e", "/")]
    rows = spark.createDataFrame([(s, i, u) for s in ("under", "above", "apart", "root") for i, u in enumerate(urls)],
                                 "site string, ord long, url string")
    kept = {}
    for r in discovery.subtree_fallback(rows, sites).collect():
        kept.setdefault(r.site, set()).add(r.url.removeprefix("https://a.com"))
    assert kept == {"under": {"/d/x"}, "above": {"/d/x", "/d"}, "apart": {"/z/"}, "root": {"/d/x", "/d", "/e", "/"}}

    graph = {"https://a.com/d/x": ["1", "2", "1", "3", "https://a.com/d/x", "https://a.com/e"], "https://a.com/d": ["/d/2", "/d/4", "/d/5", "/d/6"]}
    seeds = spark.createDataFrame([("s", i, u) for i, u in enumerate([*graph, "https://a.com/d/9"])], "site string, ord long, url string")
    pages = pages_of(spark, {**graph, "https://a.com/d/9": ["/never", "/d/7"]})
    def expand(per_seed, **kw):
        got = discovery.expand_seeds(seeds, site_rows(spark, ("s", "https://a.com/d/", 0, 0, "auto")), pages, per_seed=per_seed, **kw)
        return [r.url.removeprefix("https://a.com/d/") for r in got.orderBy("ord").collect()]
    assert expand(None) == expand(5000) == ["1", "2", "3", "4", "5", "6"]
    assert expand(1) == ["1", "2"] and expand(2) == ["1", "2", "4", "5"]
    assert expand(None, seeds=None) == ["1", "2", "3", "4", "5", "6", "https://a.com/never", "7"] and expand(None, seeds=1) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        expand(1, seeds=None)


def test_llms_links(spark):
    text = ("# Lattice\n> notes\n- [Tour](https://a.com/tour) and [All of it](llms-full.txt)\n"
            "https://a.com/notes.md..\nno link here\n  http://b.com/x  \n![pic](img/p.png) [open](broken link)\n[two\nlines](/two)")
    docs = spark.createDataFrame([("https://a.com/", text)], "base string, text string")
    assert [r.url for r in discovery.parse_llms_links(docs).orderBy("ord").collect()] == [
        "https://a.com/tour", "https://a.com/llms-full.txt", "https://a.com/img/p.png", "https://a.com/two",
        "https://a.com/notes.md", "http://b.com/x"]


def test_rank_of_a_hot_group(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("site"),
        F.xxhash64("id").alias("k"), "id").repartition(6)
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("k", "id")))
    got = rank_in_group(rows, ["site"], ["k", "id"], "rank")
    assert got.exceptAll(want).isEmpty() and got.count() == 20_000
    for n in (7, 5000):
        first = top_n(rows, ["site"], ["k", "id"], n)
        assert first.exceptAll(want.filter(F.col("rank") <= n).drop("rank")).isEmpty()
        assert first.count() == want.filter(F.col("rank") <= n).count()


def test_sort_order(spark):
    sites = site_rows(spark, ("s", "https://a.com/en/latest/", 0, 0, "auto"))
    urls = ["/en/latest/b", "/en/latest/a/c", "/en/latest", "/x", "/en/latest/a", "/en/latest/a?hl=2", "/en/latest/a?hl=1"]
    rows = spark.createDataFrame([("s", i, "https://a.com" + u) for i, u in enumerate(urls)], "site string, ord long, url string")
    got = [r.url.removeprefix("https://a.com") for r in frontier.sort_urls(rows, sites).orderBy("ord").collect()]
    assert got == ["/en/latest/a", "/en/latest/a?hl=2", "/en/latest/a?hl=1", "/en/latest/b", "/en/latest/a/c", "/x", "/en/latest"]


def test_first_pages_keep_the_first_copy(spark):
    rows = [("s", 3, "https://A.com/x/", "c"), ("s", 1, "https://a.com/x?u=1", "a"), ("t", 2, "https://a.com/x", "t"), ("s", 4, "ftp://x", "n")]
    frame = spark.createDataFrame(rows, "site string, ord long, url string, html string")
    assert sorted((r.site, r.url, r.html) for r in frontier.first_pages(frame).collect()) == [
        ("s", "https://a.com/x", "a"), ("t", "https://a.com/x", "t")]


SCHEMA = "url string, status int, html string, fetched_at double"


def test_upsert_scan_and_frontier(spark):
    cache = spark.createDataFrame([("a", 200, "a1", 1.0), ("b", 200, "b1", 5.0), ("c", 200, "", 1.0)], SCHEMA)
    new = spark.createDataFrame([("a", 200, "a2", 2.0), ("a", 200, "a3", 3.0), ("a", 500, "bad", 9.0), ("b", 200, "late", 4.0),
                                 ("d", 404, "", 1.0), ("e", 200, "e1", 1.0), ("c", 200, "c2", 1.0)], SCHEMA)
    merged = upsert(cache, new)
    assert sorted((r.url, r.html) for r in merged.collect()) == [("a", "a3"), ("b", "b1"), ("c", "c2"), ("e", "e1")]
    urls = spark.createDataFrame([("s", 1, "a"), ("s", 2, "c"), ("s", 3, "z")], "site string, ord long, url string")
    assert [r.url for r in frontier.frontier(urls, cache).orderBy("ord").collect()] == ["c", "z"]
    assert frontier.frontier(urls, cache, fresh=True).count() == 3
    assert [(r.url, r.html) for r in scan_pages(urls, cache).orderBy("ord").collect()] == [("a", "a1"), ("c", None), ("z", None)]
    assert scan_pages(urls, cache, fresh=True).filter("html is not null").isEmpty()


def test_reports(spark):
    rows = [("s", i, f"u{i}", "p" if i in (2, 3) else f"p{i}", "boom" if i % 2 else "") for i in range(30)] + [("t", 0, "v", "p", "")]
    frame = spark.createDataFrame(rows, "site string, ord long, url string, path string, error string")
    summary = reports.run_summary(frame).collect()
    assert [r.ord for r in sorted(summary) if r.site == "s"] == list(range(1, 20, 2))
    assert {(r.site, r.pages, r.failed, r.more) for r in summary} == {("s", 15, 15, 5), ("t", 1, 0, 0)}
    assert [tuple(r) for r in reports.path_collisions(frame).collect()] == [("s", "p", 2, 3)]
    assert reports.last_writer(frame).filter("path = 'p'").count() == 2
    shown = reports.inspect_urls(frame.withColumn("source", F.lit("bfs")), 5)
    assert sorted((r.site, r.ord, r.total) for r in shown.collect()) == [("s", i, 30) for i in range(5)] + [("t", 0, 1)]


def test_sites_table(spark):
    rows = sites_frame(spark, [SiteConfig("https://a.com", include=["/d/*"], max_pages=3)]).collect()
    assert rows[0].max_pages == 3 and rows[0].exclude_re is None and rows[0].include_re
    en, fr = SiteConfig("https://a.com/en", include=["/en/*"]), SiteConfig("https://a.com/fr", include=["/fr/*"])
    with pytest.raises(ValueError):
        sites_frame(spark, [en, fr])
    en.name, fr.name = "en", "fr"
    assert sorted(r.site for r in sites_frame(spark, [en, fr]).collect()) == ["en", "fr"]
