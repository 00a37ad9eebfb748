"""Registered queries for discovery: llms.txt, sitemaps, expansion and the crawl graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.platforms import known_adapter
from ..operators import discovery, frontier, reports
from ..operators.links import link_graph
from ..sources.sitemap import sitemap_locs as locs_of
from . import derived as d
from . import oracle as o
from .harvest import harvest as harvest_of
from .harvest import inspect_sites
from .page_queries import _SQL_CLEAN, _SQL_DETECTED, _SQL_TITLE
from .url_queries import _SQL_DEDUPED, _STORED, _stored, site_urls

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# platform of a site --------------------------------------------------------------------------------

# One site per page, started on it; some name their adapter, some start pages failed.
_START = "url || '?id=' || CAST(page_id AS STRING)"
_ADAPTER = """CASE page_id % 4 WHEN 1 THEN 'hugo' WHEN 2 THEN 'auto' WHEN 3 THEN 'unheard-of' ELSE 'auto' END"""
_STATUS = "CASE page_id % 9 WHEN 8 THEN 500 ELSE 200 END"


@query("site_platform", f"""
SELECT site, platform, CASE WHEN platform = 'unheard-of' THEN 'generic' ELSE platform END AS rules FROM (
  SELECT 'p' || page_id AS site, CASE {_ADAPTER} WHEN 'auto' THEN CASE {_STATUS} WHEN 200 THEN platform ELSE 'generic' END
    ELSE {_ADAPTER} END AS platform FROM {_SQL_DETECTED})""")
def site_platform(spark, sf):
    pages = d.derive(spark, sf, d.HEAD_PAGES)
    sites = pages.select(F.expr("'p' || page_id").alias("site"), F.expr(_START).alias("url"), F.expr(_ADAPTER).alias("adapter"))
    stored = pages.select(F.expr(_START).alias("url"), F.expr(_STATUS).alias("status"), "html")
    return discovery.site_platform(sites, stored).select("site", "platform", known_adapter(F.col("platform")).alias("rules"))


# llms.txt and robots.txt ---------------------------------------------------------------------------

def _text_sites(spark, sf):
    """Sites, and the resources llms.txt, llms-full.txt and robots.txt of each."""
    rows = d.derive(spark, sf, d.TEXT_SITES)
    base = F.regexp_replace("url", "/docs/$", "")
    files = F.explode(F.array(*(
        F.struct(F.concat(base, F.lit(f"/{name}.txt")).alias("url"), F.col(column).alias("html"))
        for name, column in (("llms", "llms"), ("llms-full", "llms_full"), ("robots", "robots")))))
    resources = rows.select(files.alias("f")).select("f.url", F.lit(200).alias("status"), "f.html")
    return rows.drop("llms", "llms_full", "robots"), resources


_SQL_LLMS = f"""(
SELECT site, adapter, base, no, CASE WHEN no <= marked THEN abs_url ELSE href END AS url FROM {o.with_resolved(f'''(
  SELECT *, generate_subscripts(l, 1) AS no, unnest(l) AS href FROM (SELECT *, m || b AS l, len(m) AS marked FROM (
    SELECT site, adapter, 'https://' || split_part(url, '/', 3) AS base,
      regexp_extract_all(llms, '\\[[^\\]]*\\]\\(([^)\\s]+)\\)', 1) AS m,
      list_filter(list_transform(string_split(llms, chr(10)), lambda x: rtrim(trim(x), '.')), lambda x: x LIKE 'http%://%') AS b
    FROM {o.derived(d.TEXT_SITES)})))''', 'base')})"""


@query("llms_links", f"SELECT site, no - 1 AS ord, url FROM {_SQL_LLMS}")
def llms_links(spark, sf):
    docs = d.derive(spark, sf, d.TEXT_SITES).select(
        "site", discovery.base_of(F.col("url")).alias("base"), F.col("llms").alias("text"))
    return discovery.parse_llms_links(docs).select("site", "ord", "url")


_SQL_FULL = (f"(SELECT site, 'https://' || split_part(url, '/', 3) || '/llms-full.txt' AS url, llms_full AS text "
             f"FROM {o.derived(d.TEXT_SITES)} WHERE adapter <> 'sphinx' AND instr(llms, 'llms-full') > 0 AND llms_full <> '')")


@query("llms_urls", f"""
SELECT site, min(no) - 1 AS ord, canonical AS url FROM {o.with_canonical(_SQL_LLMS)}
WHERE adapter <> 'sphinx' AND {o.host_of('canonical')} = {o.host_of('base')} AND {o.path_of('canonical')} <> '/search'
  AND canonical NOT LIKE '%/llms-full.txt' AND site NOT IN (SELECT site FROM {_SQL_FULL}) GROUP BY site, canonical""")
def llms_urls(spark, sf):
    return discovery.llms_urls(*_text_sites(spark, sf))[0].select("site", F.col("ord").cast("bigint").alias("ord"), "url")


@query("llms_full", f"SELECT site, url, text, length(text)::BIGINT AS chars FROM {_SQL_FULL}")
def llms_full(spark, sf):
    return discovery.llms_urls(*_text_sites(spark, sf))[1].withColumn("chars", F.length("text").cast("bigint"))


@query("robots_sitemaps", f"""
SELECT site, unnest([0, 1, 4])::BIGINT AS ord, base || unnest(['/sitemap.xml', '/sitemap_index.xml', '/maps/' || substr(site, 2) || '.xml']) AS url
FROM (SELECT site, 'https://' || split_part(url, '/', 3) AS base FROM {o.derived(d.TEXT_SITES)})""")
def robots_sitemaps(spark, sf):
    return discovery.robots_sitemaps(*_text_sites(spark, sf)).withColumn("ord", F.col("ord").cast("bigint"))


# sitemap files -------------------------------------------------------------------------------------

@query("sitemap_locs", f"""
SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, replace(unnest(l), '&amp;', '&') AS loc
FROM (SELECT page_id, regexp_extract_all(html, '<loc>([^<]*)</loc>', 1) AS l FROM {o.derived(d.SITEMAPS)})""")
def sitemap_locs(spark, sf):
    parsed = d.derive(spark, sf, d.SITEMAPS).select("page_id", discovery.once(locs_of(F.col("html"))).alias("locs"))
    return parsed.select("page_id", F.posexplode("locs").alias("pos", "loc")).withColumn("pos", F.col("pos").cast("bigint"))


_SITEMAP_SITES = """SELECT 'p' || CAST(page_id AS STRING) AS site, page_id, 'https://docs.example.org/' AS url, 'generic' AS platform,
  CAST(NULL AS STRING) AS include_re, CAST(NULL AS STRING) AS exclude_re FROM {pages}"""


@query("sitemap_tree", f"""
WITH RECURSIVE f AS (SELECT 'p' || page_id AS site, page_id AS id, repeat('0', 10) AS file FROM pages
  UNION ALL SELECT f.site, c.page_id, f.file || '0' || lpad((c.page_id - 2 * f.id - 1)::VARCHAR, 10, '0')
  FROM f JOIN pages c ON c.page_id = 2 * f.id + 1 OR (c.page_id = 2 * f.id + 2 AND f.id % 4 <> 1)
  WHERE f.id % 19 <> 18)
SELECT site, file || '1' || repeat('0', 10) AS ord, canonical AS url FROM f JOIN {o.with_canonical(
  "(SELECT page_id AS id, 'https://docs.example.org/' || split_part(url, '/', 4) || '/' || "
  "split_part(split_part(split_part(url, '?', 1), '#', 1), '/', 5) || '/' AS loc FROM pages)", 'loc')} USING (id)
WHERE id % 19 <> 18 AND {o.kept(o.path_of('canonical'), "'generic'")}""")
def sitemap_tree(spark, sf):
    sites = d.derive(spark, sf, _SITEMAP_SITES)
    files = d.derive(spark, sf, d.SITEMAPS)
    candidates = files.select(F.expr("'p' || page_id").alias("site"), F.lit(0).alias("ord"), "url")
    return discovery.sitemap_tree(candidates, sites, files)


# Start URLs of three kinds: with pages below them, below a page, and apart from all pages.
_STARTS = f"""SELECT site, CASE length(site) % 3 WHEN 0 THEN url WHEN 1 THEN first || '/deep/x' ELSE url || 'none/' END AS url
FROM ({d.SITES}) s JOIN (SELECT split_part(url, '/', 3) AS site, min(split_part(split_part(url, '?', 1), '#', 1)) AS first
FROM {{pages}} GROUP BY 1) f USING (site)"""


@query("subtree_fallback", f"""
SELECT site, url, tier::BIGINT AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY site) AS best FROM (
  SELECT site, u.url, CASE WHEN starts_with({o.path_of('u.url')}, {o.path_of('s.url')}) THEN 0
    WHEN starts_with({o.path_of('s.url')}, {o.path_of('u.url')}) AND {o.path_of('u.url')} <> '/' THEN 1 END AS tier
  FROM {_SQL_DEDUPED} u JOIN {o.derived(_STARTS)} s USING (site)
  UNION ALL SELECT DISTINCT site, s.url, 2 FROM {_SQL_DEDUPED} u JOIN {o.derived(_STARTS)} s USING (site)) WHERE tier IS NOT NULL)
WHERE tier = best""")
def subtree_fallback(spark, sf):
    starts = d.derive(spark, sf, _STARTS)
    kept = discovery.subtree_fallback(frontier.dedupe_urls(site_urls(spark, sf)), starts)
    path, start = discovery.url_path(F.col("url")), discovery.url_path(F.col("start"))
    tier = F.when(F.col("url") == F.col("start"), 2).when(path.startswith(start), 0).otherwise(1)
    return kept.join(starts.select("site", F.col("url").alias("start")), "site").select(
        "site", "url", tier.cast("bigint").alias("tier"))


# links ---------------------------------------------------------------------------------------------

_PER_SEED = 4
_SQL_SEED_LINKS = f"""(
SELECT site, seed, dst_url AS url, min(pos) AS pos FROM (SELECT site, seed, url AS src_url FROM
    (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ord) AS seed FROM {_SQL_DEDUPED}) WHERE seed <= 2)
  JOIN {o.with_resolved(o.anchors(f"(SELECT * FROM {_STORED} WHERE status = 200)"))} USING (src_url)
WHERE {o.host_of('dst_url')} = {o.host_of('src_url')} AND {o.path_of('dst_url')} <> '/' AND dst_url <> src_url
  AND {o.kept(o.path_of('dst_url'), "'generic'")} GROUP BY ALL)"""


@query("expand_seeds", f"""
WITH links AS (SELECT * FROM {_SQL_SEED_LINKS}),
  one AS (SELECT site, seed, url, pos FROM links WHERE seed = 1 QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos) <= {_PER_SEED}),
  two AS (SELECT site, seed, url, pos FROM links ANTI JOIN one USING (site, url) WHERE seed = 2
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos) <= {_PER_SEED})
SELECT site, url, (seed * 4294967296 + pos)::BIGINT AS ord FROM one UNION ALL SELECT site, url, (seed * 4294967296 + pos)::BIGINT FROM two""")
def expand_seeds(spark, sf):
    urls = frontier.dedupe_urls(site_urls(spark, sf))
    return discovery.expand_seeds(urls, d.derive(spark, sf, d.SITES), _stored(spark, sf), per_seed=_PER_SEED)


# One crawl per language, from its first page; two of them are cut by depth.
_CRAWLS = """SELECT split_part(url, '/', 4) AS site, 'https://docs.example.org/p/' || CAST(min(page_id) AS STRING) AS url,
  'generic' AS platform, CAST(NULL AS STRING) AS include_re, CAST(NULL AS STRING) AS exclude_re, 0 AS max_pages,
  CASE split_part(url, '/', 4) WHEN 'de' THEN 3 WHEN 'es' THEN 2 ELSE 0 END AS max_depth FROM {pages} GROUP BY 1"""


_SQL_CRAWLED = f"""(
WITH RECURSIVE edges AS (SELECT DISTINCT src_url, dst_url FROM {o.with_resolved(o.anchors(f"(SELECT * FROM {o.derived(d.GRAPH_PAGES)} WHERE status = 200)"))}
    WHERE {o.host_of('dst_url')} = 'docs.example.org' AND {o.kept(o.path_of('dst_url'), "'generic'")}
      AND {o.path_of('dst_url')} <> '/'),
  absolute AS (SELECT DISTINCT src_url, dst_url FROM {o.with_resolved(o.anchors(f"(SELECT * FROM {o.derived(d.GRAPH_PAGES)} WHERE status = 200)"))}
    WHERE href NOT LIKE 'http%'),
  hops AS (SELECT e.*, a.src_url IS NULL AS only_absolute FROM edges e LEFT JOIN absolute a USING (src_url, dst_url)),
  crawl AS (SELECT site, url, url AS start, max_depth, 0 AS depth FROM {o.derived(_CRAWLS)}
    UNION SELECT site, dst_url, start, max_depth, depth + 1 FROM crawl JOIN hops ON src_url = crawl.url
    WHERE (max_depth = 0 OR depth < max_depth) AND depth < 16
      AND (NOT only_absolute OR starts_with({o.path_of('dst_url')}, {o.path_of('start')})))
SELECT site, url, start, min(depth)::BIGINT AS depth FROM crawl GROUP BY site, url, start)"""


@query("link_bfs", f"SELECT site, url, depth FROM {_SQL_CRAWLED}")
def link_bfs(spark, sf):
    graph = link_graph(d.derive(spark, sf, d.GRAPH_PAGES))
    return discovery.crawl_graph(d.derive(spark, sf, _CRAWLS), graph).select(
        "site", "url", F.col("depth").cast("bigint").alias("depth"))


# the whole discovery -------------------------------------------------------------------------------

# Half of the sites have a sitemap robots.txt names; all have a start page with links.
_SITE_FILES = """SELECT base || '/maps/' || CAST(page_id AS STRING) || '.xml' AS url, 200 AS status,
  CASE WHEN page_id % 2 = 0 THEN '<urlset><loc>' || base || '/docs/a/</loc><loc>' || base || '/blog/x</loc><loc>' || base
    || '/docs/b.html</loc></urlset>' ELSE 'not a sitemap' END AS html FROM {bases}
UNION ALL SELECT base || '/docs', 200, '<html><body><a href="/docs/one">1</a><a href="two">2</a><a href="/search/x">s</a></body></html>'
FROM {bases}"""
_SQL_OPEN = f"""(SELECT site, page_id, 'https://' || split_part(url, '/', 3) AS base FROM
  (SELECT *, substr(site, 2)::BIGINT AS page_id FROM {o.derived(d.TEXT_SITES)})
  WHERE adapter = 'sphinx' OR (adapter = 'auto' AND page_id % 4 = 1))"""


@query("discover", f"""
SELECT site, 'llms.txt' AS source, row_number() OVER (PARTITION BY site ORDER BY min(no)) AS ord, canonical AS url
FROM {o.with_canonical(_SQL_LLMS)} WHERE adapter <> 'sphinx' AND {o.host_of('canonical')} = {o.host_of('base')}
  AND {o.path_of('canonical')} <> '/search' AND canonical NOT LIKE '%/llms-full.txt' AND site NOT IN (SELECT site FROM {_SQL_FULL})
  GROUP BY site, canonical
UNION ALL SELECT site, 'sitemap', unnest([1, 2]), base || unnest(['/docs/a', '/docs/b.html']) FROM {_SQL_OPEN} WHERE page_id % 2 = 0
UNION ALL SELECT site, 'bfs', unnest([1, 2, 3]), base || unnest(['/docs/one', '/docs', '/two']) FROM {_SQL_OPEN} WHERE page_id % 2 = 1
UNION ALL SELECT site, 'llms-full', 1, url FROM {_SQL_FULL}""")
def discover(spark, sf):
    """All sources for all sites in one run, whole-site files included."""
    sites, texts = _text_sites(spark, sf)
    bases = sites.select(F.regexp_replace("url", "/docs/$", "").alias("base"), F.expr("CAST(substr(site, 2) AS BIGINT)").alias("page_id"))
    resources = texts.unionByName(spark.sql(_SITE_FILES, bases=bases))
    urls, full = discovery.discover(sites, discovery.written(resources, "resources"))
    return urls.select("site", "source", F.col("ord").cast("bigint").alias("ord"), "url").unionByName(
        full.select("site", F.lit("llms-full").alias("source"), F.lit(1).cast("bigint").alias("ord"), "url"))


def _text_site_settings(sites):
    return sites.select("site", "url", "adapter", "include_re", "exclude_re", "max_pages", "max_depth",
                        F.array(F.lit("md")).alias("formats"))


@query("inspect_full", f"SELECT site, url, length(text)::BIGINT AS chars FROM {_SQL_FULL}")
def inspect_full(spark, sf):
    """Preview of the sites that one whole-site file serves."""
    sites, texts = _text_sites(spark, sf)
    return reports.inspect_full(inspect_sites(_text_site_settings(sites), discovery.written(texts, "resources"))[2])


# the whole run -------------------------------------------------------------------------------------

@query("harvest", f"""
SELECT c.site, c.url, 'bfs' AS source, row_number() OVER (PARTITION BY c.site ORDER BY
    CASE WHEN starts_with({o.path_of('c.url')}, {o.path_of('c.start')}) THEN 0 ELSE 1 END,
    len(string_split({o.path_of('c.url')}, '/')), {o.path_of('c.url')}) AS ord,
  g.status::BIGINT AS status, CASE WHEN g.status <> 200 THEN 'HTTP ' || g.status WHEN g.status = 200 THEN '' END AS error,
  CASE WHEN g.status <> 200 THEN '' WHEN g.status = 200 THEN g.cleaned END AS title, coalesce(g.status, 0) <> 200 AS todo
FROM {_SQL_CRAWLED} c LEFT JOIN (SELECT url, status, {_SQL_CLEAN} AS cleaned FROM (
  SELECT *, regexp_split_to_array(title, '\\s*[|·–—:-]\\s*') AS l FROM (
    SELECT url, status, {_SQL_TITLE} AS title FROM {o.derived(d.GRAPH_PAGES)}))) g ON g.url = c.url""")
def harvest(spark, sf):
    """Every URL the whole run discovers, with the outcome of its page and whether it still needs a fetch."""
    sites = d.derive(spark, sf, _CRAWLS).drop("platform").withColumn("adapter", F.lit("auto")).withColumn(
        "formats", F.array(F.lit("md")))
    stored = d.derive(spark, sf, d.GRAPH_PAGES).withColumn("fetched_at", F.lit(0.0))
    run = harvest_of(sites, discovery.written(stored, "resources"))
    pages = run.pages.select("site", "url", F.col("status").cast("bigint").alias("status"), "error", "title")
    todo = run.todo.select("site", "url", F.lit(True).alias("todo"))
    return (run.urls.join(pages, ["site", "url"], "left").join(todo, ["site", "url"], "left")
            .select("site", "url", "source", F.col("ord").cast("bigint").alias("ord"), "status", "error", "title",
                    F.coalesce("todo", F.lit(False)).alias("todo")))
