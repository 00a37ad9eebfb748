"""Registered queries for URL functions, filters and URL lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SiteConfig, sites_frame
from ..config import site_rules as rules_of
from ..functions import filters, urls
from ..functions.text import glob_regex, strip
from ..operators import frontier, links, reports
from ..session import small_side
from ..sources.resources import scan_pages, upsert
from . import derived as d
from . import oracle as o

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


# URL functions -------------------------------------------------------------------------------------

@query("normalize_url", f"SELECT page_id, url, canonical FROM {o.with_canonical(o.derived(d.RAW_URLS))}")
def normalize(spark, sf):
    return d.derive(spark, sf, d.RAW_URLS).select("page_id", "url", urls.normalize_url(F.col("url")).alias("canonical"))


@query("url_parts", f"""
SELECT page_id, lower(u.s) AS scheme, lower(u.n) AS host, u.p AS path, u.q AS query,
  'http' || CASE WHEN lower(url) LIKE '%https://%' THEN 's' ELSE '' END || '://' || lower(u.n) AS base
FROM (SELECT *, {o.parts('url')} AS u FROM {o.derived(d.RAW_URLS)}) WHERE lower(u.s) LIKE 'http%'""")
def parts(spark, sf):
    raw = d.derive(spark, sf, d.RAW_URLS).withColumn("url", strip(F.col("url")))
    p = urls.url_parts(F.col("url"))
    return raw.filter(p.scheme.startswith("http")).select(
        "page_id", p.scheme.alias("scheme"), urls.host_of(F.col("url")).alias("host"), p.path.alias("path"),
        p.query.alias("query"), F.lower(urls.base_of(F.col("url"))).alias("base"))


@query("url_ext", f"SELECT page_id, url, {o.ext_of(o.path_of('url'))} AS ext FROM {o.derived(d.CHECKED_URLS)}")
def ext(spark, sf):
    return d.derive(spark, sf, d.CHECKED_URLS).select("page_id", "url", urls.url_ext(F.col("url")).alias("ext"))


_SEGMENT = r"rtrim(trim(regexp_replace(s, '[<>:\"\\|?*]', '_', 'g')), '. ')"


def _sql_rel_path(source: str, keep: str) -> str:
    cut = f"regexp_replace({o.path_of('url')}, '(?i)\\.(html?|md|xhtml|txt)$', '')"
    reserved = "regexp_matches(upper(s), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$')"
    return f"""
SELECT {keep}, array_to_string(list_transform(list_transform(
    CASE WHEN len(l) = 0 THEN ['index'] WHEN len(l) > 1 AND lower(l[-1]) IN ('index', 'index.htm') THEN l[:-2] ELSE l END,
    lambda s: coalesce(nullif({_SEGMENT}, ''), 'index')),
    lambda s: CASE WHEN {reserved} THEN '_' || s ELSE s END), '/') AS path
FROM (SELECT *, list_filter(string_split({cut}, '/'), lambda s: s <> '') AS l FROM {source})"""


@query("rel_path", _sql_rel_path(o.derived(d.PATH_URLS), "page_id, url"))
def rel_path(spark, sf):
    return d.derive(spark, sf, d.PATH_URLS).select("page_id", "url", urls.rel_path(F.col("url")).alias("path"))


@query("path_collisions", f"""
SELECT 'all' AS site, path, count(*)::BIGINT AS urls, max(page_id)::BIGINT AS kept
FROM ({_sql_rel_path('pages', 'page_id')}) GROUP BY path HAVING count(*) > 1""")
def path_collisions(spark, sf):
    pages = d.table(spark, sf, "pages").select(
        F.lit("all").alias("site"), urls.rel_path(F.col("url")).alias("path"), F.col("page_id").alias("ord"))
    return reports.path_collisions(pages)


# Links as other sites write them, made from the links of the pages.
_WRITTEN = """CASE (pos + page_id) % 8 WHEN 1 THEN substr(href, 2) WHEN 2 THEN '../' || substr(href, 2)
  WHEN 3 THEN '//cdn.example.org' || href WHEN 4 THEN split_part(src_url, '/', 1) || '//' || split_part(src_url, '/', 3) || '/' || split_part(src_url, '/', 4) || href
  WHEN 5 THEN './a/../' || substr(href, 2) || '?hl=en#top' WHEN 6 THEN 'mailto:x@example.org' WHEN 7 THEN '#top'
  ELSE href END"""
_SQL_WRITTEN = f"(SELECT page_id, src_url, pos, {_WRITTEN} AS href FROM {o.anchors('pages', 'page_id, url AS src_url')})"


def written_links(spark, sf):
    found = d.rows(spark, sf, "pages").select(F.concat("page_id", F.lit(" "), "url").alias("url"), "html")   # keep repeated URLs apart
    found = links.extract_links(found).select(
        F.substring_index("src_url", " ", 1).cast("bigint").alias("page_id"),
        F.expr("split_part(src_url, ' ', 2)").alias("src_url"), "pos", "href")
    return found.withColumn("href", F.expr(_WRITTEN))


@query("extract_links", f"SELECT src_url, pos::BIGINT AS pos, href FROM {o.anchors('pages')}")
def extract_links(spark, sf):
    return links.extract_links(d.rows(spark, sf, "pages")).withColumn("pos", F.col("pos").cast("bigint"))


@query("resolve_links", f"SELECT page_id, pos::BIGINT AS pos, href, abs_url, dst_url FROM {o.with_resolved(_SQL_WRITTEN)}")
def resolve_links(spark, sf):
    return links.resolve_links(written_links(spark, sf)).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "abs_url", "dst_url")


@query("internal_links", f"""
SELECT page_id, pos::BIGINT AS pos, dst_url FROM {o.with_resolved(_SQL_WRITTEN)}
WHERE {o.host_of('dst_url')} = {o.host_of('src_url')}""")
def internal_links(spark, sf):
    found = links.resolve_links(written_links(spark, sf))
    return found.filter(urls.same_host(F.col("dst_url"), urls.host_of(F.col("src_url")))).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "dst_url")


@query("candidate_links", f"""
SELECT page_id, pos::BIGINT AS pos, href, dst_url FROM {o.with_resolved(_SQL_WRITTEN)}
WHERE {o.host_of('dst_url')} = {o.host_of('src_url')} AND CASE WHEN href LIKE 'http://%' OR href LIKE 'https://%'
  THEN {o.path_of('dst_url')} LIKE '/' || split_part(src_url, '/', 4) || '%' ELSE {o.path_of('dst_url')} <> '/' END""")
def candidate_links(spark, sf):
    found = links.resolve_links(written_links(spark, sf))
    prefix = F.concat(F.lit("/"), F.expr("split_part(src_url, '/', 4)"))
    found = links.with_host_path(found.withColumn("src_host", urls.host_of(F.col("src_url"))), "dst_url")
    inside = filters.in_subtree(F.col("href"), F.col("path"), prefix)
    return found.filter((F.col("host") == F.col("src_host")) & inside).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "dst_url")


# filters -------------------------------------------------------------------------------------------

@query("filter_urls", f"""
SELECT page_id, url, adapter, {o.asset('p')} AS asset, {o.noise('p')} AS noise, {o.platform_noise('adapter', 'p')} AS platform_noise,
  {o.kept('p', 'adapter')} AS keep, NOT ({o.platform_noise('adapter', 'p')} OR {o.noise('p')} OR {o.excluded('p')}) AS keep_md
FROM (SELECT *, {o.path_of('url')} AS p FROM {o.derived(d.CHECKED_URLS)})""")
def filter_urls(spark, sf):
    path, adapter, none = F.col("path"), F.col("adapter"), F.lit(None).cast("string")
    return links.with_host_path(d.derive(spark, sf, d.CHECKED_URLS), "url").select(
        "page_id", "url", "adapter", filters.is_asset(path).alias("asset"), filters.is_noise(path).alias("noise"),
        filters.is_platform_noise(adapter, path).alias("platform_noise"),
        filters.path_passes(path, adapter, none, none).alias("keep"),
        filters.path_passes(path, adapter, none, none, allow_md=True).alias("keep_md"))


@query("platform_noise", f"""
SELECT page_id, adapter, url FROM {o.derived(d.CHECKED_URLS)} WHERE NOT {o.platform_noise('adapter', o.path_of('url'))}""")
def platform_noise(spark, sf):
    checked = links.with_host_path(d.derive(spark, sf, d.CHECKED_URLS), "url")
    return checked.filter(~filters.is_platform_noise(F.col("adapter"), F.col("path"))).select("page_id", "adapter", "url")


_RULES = [
    SiteConfig("https://docs.example.org/en", name="en", include=["/en/*"], exclude=["/en/private*", "*.[Pp]DF"]),
    SiteConfig("https://docs.example.org/fr", name="fr", include=["/fr/[0-4]*", "/fr/?"], exclude=[]),
    SiteConfig("https://docs.example.org/de", name="de", exclude=["/de/[!0-9]*"]),
    SiteConfig("https://docs.example.org/es", name="es", include=["*/tags/*", "/es/*5*"], exclude=["*9"]),
]


@query("glob_filter", f"""
SELECT page_id, lang, p AS path FROM (SELECT *, {o.path_of('url')} AS p FROM {o.derived(d.CHECKED_URLS)})
WHERE NOT {o.excluded('p')} AND CASE lang
  WHEN 'en' THEN p GLOB '/en/*' AND NOT (p GLOB '/en/private*' OR p GLOB '*.[Pp]DF')
  WHEN 'fr' THEN p GLOB '/fr/[0-4]*' OR p GLOB '/fr/?'
  WHEN 'de' THEN NOT p GLOB '/de/[!0-9]*'
  WHEN 'es' THEN (p GLOB '*/tags/*' OR p GLOB '/es/*5*') AND NOT p GLOB '*9' ELSE false END""")
def glob_filter(spark, sf):
    rules = small_side(sites_frame(spark, _RULES).select(F.col("site").alias("lang"), "include_re", "exclude_re"), "rules")
    checked = d.derive(spark, sf, d.CHECKED_URLS).withColumn("path", urls.url_path(F.col("url")))
    return checked.join(rules, "lang").filter(
        filters.path_allowed(F.col("path"), F.col("include_re"), F.col("exclude_re"))).select("page_id", "lang", "path")


# URL lists -----------------------------------------------------------------------------------------

def site_urls(spark, sf):
    """(site, ord, url) of the raw URLs; the site is the host."""
    return d.derive(spark, sf, d.RAW_URLS).select("site", F.col("page_id").alias("ord"), "url")


def site_links(spark, sf):
    """(site, ord, url) of all links of a site's pages."""
    found = links.resolve_links(written_links(spark, sf))
    return found.select(F.expr("split_part(src_url, '/', 3)").alias("site"),
                        (F.col("page_id") * 1000 + F.col("pos")).alias("ord"), F.col("abs_url").alias("url"))


_SQL_SITE_URLS = f"(SELECT site, page_id AS ord, url FROM {o.derived(d.RAW_URLS)})"
_SQL_SITE_LINKS = (f"(SELECT split_part(src_url, '/', 3) AS site, page_id * 1000 + pos AS ord, abs_url AS url "
                   f"FROM {o.with_resolved(_SQL_WRITTEN)})")
_SQL_DEDUPED = (f"(SELECT site, canonical AS url, min(ord) AS ord FROM {o.with_canonical(_SQL_SITE_URLS)} "
                f"WHERE canonical IS NOT NULL GROUP BY ALL)")


@query("dedupe_urls", f"SELECT site, url, ord::BIGINT AS ord FROM {_SQL_DEDUPED}")
def dedupe_urls(spark, sf):
    return frontier.dedupe_urls(site_urls(spark, sf))


@query("union_dedupe", f"""
SELECT site, canonical AS url, min(list)::BIGINT AS list, arg_min(ord, (list, ord))::BIGINT AS at
FROM {o.with_canonical(f'(SELECT 0 AS list, * FROM {_SQL_SITE_URLS} UNION ALL BY NAME SELECT 1 AS list, * FROM {_SQL_SITE_LINKS})')}
WHERE canonical IS NOT NULL GROUP BY 1, 2""")
def union_dedupe(spark, sf):
    both = frontier.union_dedupe(site_urls(spark, sf), site_links(spark, sf))
    return both.select("site", "url", F.col("ord.list").cast("bigint").alias("list"), "ord.at")


_SQL_SORTED = f"""(
SELECT site, url, outside, depth, p AS path, row_number() OVER (PARTITION BY site ORDER BY outside, depth, p, ord) AS ord
FROM (SELECT s.site, s.url, s.ord, p, length(p) - length(replace(p, '/', '')) AS depth,
        CASE WHEN starts_with(p, start) THEN 0 ELSE 1 END AS outside
      FROM (SELECT *, {o.path_of('url')} AS p FROM {_SQL_DEDUPED}) s
      JOIN (SELECT site, {o.path_of('url')} AS start FROM {o.derived(d.SITES)}) USING (site)))"""


def _sorted(spark, sf):
    return frontier.sort_urls(frontier.dedupe_urls(site_urls(spark, sf)), d.derive(spark, sf, d.SITES))


@query("sort_urls", f"SELECT site, url, outside::BIGINT AS outside, depth::BIGINT AS depth, path, ord::BIGINT AS ord FROM {_SQL_SORTED}")
def sort_urls(spark, sf):
    return _sorted(spark, sf).select("site", "url", F.col("outside").cast("bigint").alias("outside"),
                                     F.col("depth").cast("bigint").alias("depth"), "path", "ord")


@query("top_pages", f"SELECT site, url, ord::BIGINT AS ord FROM {_SQL_SORTED} WHERE ord <= 3")
def top_pages(spark, sf):
    return frontier.top_pages(_sorted(spark, sf), d.derive(spark, sf, d.SITES)).select("site", "url", "ord")


# Every host is found by the crawl; some also by a sitemap or an llms.txt.
_SOURCES = """CASE WHEN length(site) % 3 = 0 AND ord % 2 = 0 THEN 'llms.txt'
  WHEN length(site) % 3 <= 1 AND ord % 2 = 1 THEN 'sitemap' ELSE 'bfs' END"""


@query("source_priority", f"""
SELECT site, url, source FROM (SELECT *, min(CASE source WHEN 'llms.txt' THEN 1 WHEN 'sitemap' THEN 2 ELSE 3 END)
  OVER (PARTITION BY site) AS best FROM (SELECT *, {_SOURCES} AS source FROM {_SQL_DEDUPED}))
WHERE best = CASE source WHEN 'llms.txt' THEN 1 WHEN 'sitemap' THEN 2 ELSE 3 END""")
def source_priority(spark, sf):
    found = frontier.dedupe_urls(site_urls(spark, sf)).withColumn("source", F.expr(_SOURCES))
    return frontier.prefer_source(found).select("site", "url", "source")


@query("undiscovered_sites", f"""
SELECT site, url FROM {o.derived(d.SITES)} WHERE site NOT IN
  (SELECT DISTINCT site FROM {_SQL_DEDUPED} WHERE {o.path_of('url')} GLOB '/fr/9*')""")
def undiscovered_sites(spark, sf):
    """Sites that an include rule leaves without any URL."""
    rule, none = F.lit(glob_regex(["/fr/9*"])), F.lit(None).cast("string")
    found = links.with_host_path(frontier.dedupe_urls(site_urls(spark, sf)), "url").filter(
        filters.path_allowed(F.col("path"), rule, none))
    return frontier.undiscovered(d.derive(spark, sf, d.SITES), found).select("site", "url")


# Stored pages under their canonical URL; failed ones have an empty body.
_STORED = f"""(SELECT canonical AS url, arg_max(status, page_id) AS status, arg_max(body, page_id) AS html FROM
  (SELECT *, CASE WHEN status = 200 THEN html ELSE '' END AS body FROM {o.with_canonical(o.derived(d.RESOURCES))}) GROUP BY 1)"""


def _stored(spark, sf):
    res = d.derive(spark, sf, d.RESOURCES).withColumn("url", urls.normalize_url(F.col("url")))
    res = res.withColumn("html", F.when(F.col("status") == 200, F.col("html")).otherwise(""))
    return res.groupBy("url").agg(F.max_by(F.struct("status", "html"), "page_id").alias("r")).select("url", "r.*")


@query("scan_pages", f"""
SELECT u.site, u.url, s.status::BIGINT AS status, length(s.html)::BIGINT AS chars FROM {_SQL_DEDUPED} u
LEFT JOIN (SELECT * FROM {_STORED} WHERE length(html) > 0) s USING (url)""")
def scan(spark, sf):
    found = frontier.dedupe_urls(site_urls(spark, sf))
    return scan_pages(found, _stored(spark, sf)).select(
        "site", "url", F.col("status").cast("bigint").alias("status"), F.length("html").cast("bigint").alias("chars"))


@query("frontier", f"""
SELECT site, url, ord::BIGINT AS ord FROM {_SQL_DEDUPED} WHERE url NOT IN (SELECT url FROM {_STORED} WHERE length(html) > 0)""")
def todo(spark, sf):
    return frontier.frontier(frontier.dedupe_urls(site_urls(spark, sf)), _stored(spark, sf)).select("site", "url", "ord")


# Events as a fetch log: the user is the page, the value its body, errors are failed fetches.
_FETCHES = """SELECT 'https://docs.example.org/u/' || CAST(user_id AS STRING) AS url,
  CASE event_type WHEN 'error' THEN 503 ELSE 200 END AS status, props AS html,
  {seconds} AS fetched_at, event_type FROM {events}"""
_SQL_FETCHES = "(" + _FETCHES.format(seconds="epoch_us(ts) / 1000000.0", events="events") + ")"


@query("cache_upsert", f"""
SELECT url, status::BIGINT AS status, html, fetched_at FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, incoming DESC, html DESC) AS k FROM (
    SELECT url, status, html, fetched_at, 0 AS incoming FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, html DESC) AS c FROM {_SQL_FETCHES}
      WHERE event_type = 'view' ) WHERE c = 1
    UNION ALL SELECT url, status, html, fetched_at, 1 AS incoming FROM {_SQL_FETCHES}
      WHERE event_type <> 'view' AND status = 200)) WHERE k = 1""")
def cache_upsert(spark, sf):
    # plain clock arithmetic, free of the session time zone
    seconds = "CAST(CAST(CAST(ts - TIMESTAMP_NTZ '1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) AS DOUBLE)"
    log = spark.sql(_FETCHES.replace("{seconds}", seconds), events=d.table(spark, sf, "events"))
    empty = log.limit(0).drop("event_type")
    cache = upsert(empty, log.filter("event_type = 'view'").drop("event_type"))
    return upsert(cache, log.filter("event_type <> 'view'").drop("event_type")).withColumn(
        "status", F.col("status").cast("bigint"))


@query("site_rules", f"""
SELECT site, coalesce(nullif(name, ''), replace(split_part(split_part(url, '://', 2), '/', 1), ':', '_')) AS name, url,
  array_to_string(CASE WHEN list_contains(formats, 'all') THEN ['md', 'json', 'jsonl', 'pdf'] ELSE formats END, ',') AS formats,
  list_contains(formats, 'all') OR list_contains(formats, 'jsonl') AS wants_jsonl
FROM (SELECT *, CASE length(site) % 3 WHEN 0 THEN site || '-docs' WHEN 1 THEN '' END AS name,
        CASE length(site) % 2 WHEN 0 THEN ['all'] ELSE ['md', 'json'] END AS formats FROM {o.derived(d.SITES)})""")
def site_rules(spark, sf):
    """Settings of every site of the pages, completed as those of a site file are."""
    sites = d.derive(spark, sf, d.SITES).withColumn("key", F.col("site"))
    name = F.expr("CASE length(site) % 3 WHEN 0 THEN site || '-docs' WHEN 1 THEN '' END")
    wanted = F.expr("CASE length(site) % 2 WHEN 0 THEN array('all') ELSE array('md', 'json') END")
    rules = rules_of(sites.withColumn("formats", wanted).withColumn("site", name))
    return rules.select(F.col("key").alias("site"), F.col("site").alias("name"), "url", F.array_join("formats", ",").alias("formats"),
                        F.array_contains("formats", "jsonl").alias("wants_jsonl"))
