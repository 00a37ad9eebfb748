import json
import os
from glob import glob

from pyspark.sql import functions as F

from pagemill.config import SiteConfig, sites_frame
from pagemill.operators.reports import inspect_full
from pagemill.plans.harvest import harvest, inspect_sites, write_outputs
from pagemill.schemas import RESOURCES
from pagemill.session import scratch_path, shared_folder, small_side
from pagemill.sources import sinks
from pagemill.sources.resources import read_resources, save_resources
from pagemill.streaming.cache_stream import read_cache, stream_upsert

from test_discovery import sitemap

ARTICLE = "<html><head><title>{t} - Site</title></head><body><main><h1>{t}</h1><p>Some prose about {t}.</p>{links}</main></body></html>"


def article(title, *hrefs):
    return ARTICLE.format(t=title, links="".join(f'<a href="{h}">link</a> ' for h in hrefs))


SITES = [
    SiteConfig("https://map.org/docs/", formats=["all"]), SiteConfig("https://walk.org/", name="walk", formats=["md", "json"], max_pages=2),
    SiteConfig("https://full.org/", formats=["jsonl"]), SiteConfig("https://list.org/", formats=["md"]),
    SiteConfig("https://gone.org/", adapter="llmstxt"),
]
FETCHED = {
    "https://map.org/robots.txt": "Sitemap: https://map.org/all.xml\nDisallow: /docs/secret",
    "https://map.org/all.xml": sitemap("https://map.org/docs/a/", "https://map.org/docs/b.html", "https://map.org/blog/c", "https://map.org/docs/x.pdf"),
    "https://map.org/docs/": article("Home"),
    "https://map.org/docs/a": article("Alpha", "/docs/more", "https://map.org/elsewhere"),
    "https://map.org/docs/b.html": article("Beta"), "https://map.org/docs/more": "plain text body\n",
    "https://walk.org/": article("Walk", "/one", "two", "/three"), "https://walk.org/one": article("One"), "https://walk.org/two": article("Two"),
    "https://full.org/llms.txt": "- [all](/llms-full.txt)\n- [x](/x.md)", "https://full.org/llms-full.txt": " # Full\nwhole site \n",
    "https://list.org/llms.txt": "[a](/a.md) [c](/gone.md) [d](/new.md) [b](https://other.org/b)\n[f](/llms-full.txt)", "https://list.org/a.md": "# A\nlisted",
}


def resources(spark):
    rows = [(u, 200, h, 100.0 + i) for i, (u, h) in enumerate(FETCHED.items())]
    return spark.createDataFrame(rows + [("https://walk.org/three", 500, "x", 1.0), ("https://list.org/gone.md", 404, "", 1.0)], RESOURCES)


def test_many_sites_end_to_end(spark, tmp_path):
    run = harvest(sites_frame(spark, SITES), resources(spark))
    found = {}
    for r in sorted(run.urls.collect(), key=lambda r: (r.site, r.ord)):
        found.setdefault((r.site, r.source), []).append(r.url)
    assert found == {
        ("map.org", "sitemap"): ["https://map.org/docs/a", "https://map.org/docs/b.html", "https://map.org/docs/more"],
        ("walk", "bfs"): ["https://walk.org/", "https://walk.org/one"],
        ("list.org", "llms.txt"): ["https://list.org/a.md", "https://list.org/gone.md", "https://list.org/new.md"],
    }
    assert [r.site for r in run.undiscovered.collect()] == ["gone.org"]
    assert sorted(r.url for r in run.todo.collect()) == ["https://list.org/gone.md", "https://list.org/new.md"]
    pages = {r.url: r for r in run.pages.collect()}
    assert pages["https://map.org/docs/a"].title == "Alpha" and pages["https://map.org/docs/more"].markdown == "plain text body"
    assert pages["https://full.org/llms-full.txt"].path == "index" and pages["https://full.org/llms-full.txt"].markdown == "# Full\nwhole site"
    manifest = {r.name: (r.pages, r.failed, r.source, r.adapter) for r in run.manifest.collect()}
    assert manifest == {"map.org": (3, 0, "sitemap", "generic"), "walk": (2, 0, "bfs", "generic"),
                        "full.org": (1, 0, "llms.txt", "llmstxt"), "list.org": (1, 1, "llms.txt", "generic")}

    out = str(tmp_path / "out")
    write_outputs(run, out, "2026-01-01T00:00:00")
    sites_with = {k: sorted(os.path.basename(p).partition("=")[2] for p in glob(f"{out}/{k}/site=*"))
                  for k in ("md", "json", "corpus_json", "corpus_jsonl", "corpus_md")}
    assert sites_with == {"md": ["list.org", "map.org", "walk"], "json": ["map.org", "walk"], "corpus_json": ["map.org", "walk"],
                          "corpus_jsonl": ["full.org", "map.org"], "corpus_md": ["full.org", "map.org"]}
    text = "".join(open(p).read() for p in sorted(glob(f"{out}/corpus_json/site=map.org/*.txt")))
    document = json.loads(text)
    assert [p["url"] for p in document["pages"]] == found["map.org", "sitemap"]
    assert document["adapter"] == "generic" and document["pages"][0]["toc"] == [{"level": 1, "title": "Alpha", "anchor": ""}]
    text = "".join(open(p).read() for p in sorted(glob(f"{out}/corpus_md/site=map.org/*.txt")))
    assert text.count("\n\n---\n\n") == 2 and text.startswith("# Alpha\n\nSource: https://map.org/docs/a\n\n# Alpha\n")
    corpus = sinks.read_corpus(spark, f"{out}/corpus_jsonl")
    assert sorted((r.site, r.url, r.seq) for r in corpus.collect())[0] == ("full.org", "https://full.org/llms-full.txt", 0)
    assert set(corpus.columns) == {"site", "url", "path", "title", "seq", "heading_path", "tokens", "text"}
    assert sinks.read_manifests(spark, f"{out}/manifest/sites/*").count() == 4


def test_limits_reach_the_discovery(spark):
    fetched = {"https://map.org/sitemap.xml": sitemap(*(f"https://map.org/{p}" for p in "abc")), "https://map.org/": article("Home"),
               **{f"https://map.org/{p}": article(p, f"/{p}{p}") for p in "abc"}}
    stored = spark.createDataFrame([(u, 200, h, 1.0) for u, h in fetched.items()], RESOURCES)
    sites = sites_frame(spark, [SiteConfig("https://map.org/", formats=["md"])])
    listed = lambda **kw: {r.url.rsplit("/", 1)[1] for r in inspect_sites(sites, stored, **kw)[1].collect()}
    assert listed() == {"a", "b", "c", "aa", "bb"} and listed(seeds=None) == {"a", "b", "c", "aa", "bb", "cc"}
    assert listed(seeds=1) == {"a", "b", "c", "aa"}


def test_whole_site_preview(spark):
    full = spark.createDataFrame([("s", "u", "héllo")], "site string, url string, text string")
    assert inspect_full(full).first().chars == 5


def test_manifest_listing_skips_unreadable_files(spark, tmp_path):
    for name, text in {"b": '{"name": "b", "url": "u", "pages": 2, "urls": ["x"],\n "source": "bfs"}', "a": '{"name": "a", "pages": 1}', "c": "{oops"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(text)
    rows = sinks.read_manifests(spark, f"{tmp_path}/*/manifest.json").collect()
    assert [(r.name, r.pages, r.source) for r in rows] == [("a", 1, None), ("b", 2, "bfs")]


def test_front_matter_and_collisions(spark):
    rows = [("s", i, f"https://a.com/{u}", "x", 200, "A: b\nc --- d", f"body {u}", "") for i, u in enumerate(["x.html", "x?q=1"])]
    pages = spark.createDataFrame(rows, "site string, ord long, url string, path string, status int, title string, markdown string, error string")
    sites = spark.createDataFrame([("s", "https://a.com/")], "site string, url string")
    files = sinks.markdown_files(pages, sites).collect()
    assert [tuple(f) for f in files] == [
        ("s", "x.md", "---\ntitle: A - b c — d\nurl: https://a.com/x?q=1\nsource: https://a.com/\n---\n\nbody x?q=1\n")]


def test_bucketed_store_needs_no_shuffle(spark, tmp_path):
    save_resources(resources(spark), "stored_resources", str(tmp_path / "store"), 4)
    try:
        urls = spark.table("stored_resources").select("url", F.lit(1).alias("one"))
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("stored_resources").join(urls, "url")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        assert read_resources(spark, str(tmp_path / "store")).count() == len(FETCHED) + 2
    finally:
        spark.sql("DROP TABLE stored_resources")


def test_streaming_upsert(spark, tmp_path):
    incoming, root, checkpoint = (str(tmp_path / n) for n in ("in", "cache", "checkpoint"))

    def fetch(*rows):
        spark.createDataFrame(rows, RESOURCES).coalesce(1).write.mode("append").parquet(incoming)
        stream_upsert(spark, incoming, root, checkpoint).awaitTermination()
        return sorted((r.url, r.html) for r in read_cache(spark, root).collect())

    assert read_cache(spark, root).isEmpty()
    assert fetch(("a", 200, "a1", 1.0), ("b", 404, "", 1.0)) == [("a", "a1")]
    assert fetch(("a", 200, "a3", 3.0), ("c", 200, "c1", 1.0)) == [("a", "a3"), ("c", "c1")]
    assert fetch(("a", 200, "late", 2.0)) == [("a", "a3"), ("c", "c1")]
    # a new checkpoint reads all files again and goes on after the versions that are there
    checkpoint = str(tmp_path / "another")
    assert fetch(("d", 200, "d1", None)) == [("a", "a3"), ("c", "c1"), ("d", "d1")]
    assert fetch(("d", 200, "d2", 1.0)) == [("a", "a3"), ("c", "c1"), ("d", "d2")]
    newest = max((p for p in (tmp_path / "cache").iterdir()), key=lambda p: int(p.name.partition("=")[2]))
    assert len([p for p in newest.iterdir() if p.name.startswith("bucket=")]) == 1  # only what the batch touched


def test_broadcast_is_size_checked(spark):
    def hinted(rows, **kw):
        return "broadcast" in small_side(spark.range(rows), "side", **kw)._jdf.queryExecution().logical().toString()
    assert hinted(10) and not hinted(11, max_rows=10)


def test_shared_folder_is_the_configured_one(spark):
    assert scratch_path(spark, "x").startswith(shared_folder(spark)) and spark.sparkContext.getCheckpointDir()
