"""Discovery: llms.txt, sitemap trees, one-hop expansion and the crawl graph, for all sites at once.

``sites`` rows follow ``schemas.SITES`` with ``platform`` added (the adapter in force); ``resources``
rows follow ``schemas.RESOURCES``, ``pages`` are its HTML rows, ``links`` is the output of ``links.link_graph``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import in_subtree, path_allowed, path_passes, prefix_of
from ..functions.platforms import detect_platform
from ..functions.text import SPACE, lines, once, strip
from ..functions.urls import base_of, host_of, normalize_url, resolve_url, same_host, url_path
from ..session import LEVEL_ROWS, bucketed, join_side, scratch_path, small_side, written
from ..sources.sitemap import sitemap_locs
from .frontier import best_only, dedupe_urls, prefer_source, sort_urls, union_dedupe
from .links import link_graph, with_host_path
from .ranking import rank_in_group, top_n

# Pages per site that are expanded by one hop.
SEEDS = 2
# Digits of a position inside an order key.
_DIGITS = 10

# What a source of URLs gives.
_FOUND = "site string, ord bigint, url string, source string"

_MARKDOWN_LINK = rf"\[[^\]]*\]\(([^){SPACE}]+)\)"


def site_platform(sites: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds ``platform``: the explicit adapter, else detection on the start page, else generic.

    The start page is the one stored under the start URL as written, else under its canonical form.
    """
    canonical = F.coalesce(normalize_url(F.col("url")), F.col("url"))
    starts = small_side(sites.select(F.explode(F.array("url", canonical)).alias("_home")).distinct(), "starts")
    home = resources.filter(F.col("status") == 200).join(starts, F.col("url") == F.col("_home"))
    home = written(home.select("_home", detect_platform(F.col("html"), F.col("_home")).alias("_found")), "home")
    home = home.dropDuplicates(["_home"])
    return (sites.withColumn("_canonical", canonical)
            .join(home.select(F.col("_home").alias("_raw_home"), F.col("_found").alias("_raw")), F.col("url") == F.col("_raw_home"), "left")
            .join(home, F.col("_canonical") == F.col("_home"), "left")
            .withColumn("platform", F.when(F.col("adapter") != "auto", F.col("adapter"))
                        .otherwise(F.coalesce("_raw", "_found", F.lit("generic"))))
            .drop("_canonical", "_raw_home", "_raw", "_home", "_found"))


def _rules(sites: DataFrame) -> DataFrame:
    """The columns link checks need, as a size-checked join side."""
    return small_side(sites.select(
        "site", host_of(F.col("url")).alias("origin"), "platform", "include_re", "exclude_re"), "rules")


def _passes() -> Column:
    return path_passes(F.col("path"), F.col("platform"), F.col("include_re"), F.col("exclude_re"))


def _sitemap_name(url: Column) -> Column:
    return F.lower(url).contains("sitemap") & F.lower(url).endswith(".xml")


def site_files(resources: DataFrame) -> DataFrame:
    """The few resources discovery reads as text, written once: a URL-only filter over the scan.

    Covers llms.txt, llms-full*, robots.txt and every file name a sitemap index may lead to.
    """
    name = F.substring_index("url", "/", -1)
    wanted = name.isin("llms.txt", "robots.txt") | name.startswith("llms-full") | _sitemap_name(F.col("url"))
    return written(resources.filter((F.col("status") == 200) & wanted).select("url", "status", "html"), "site-files")


# llms.txt ------------------------------------------------------------------------------------------

def llms_link_list(text: Column) -> tuple[Column, Column]:
    """Markdown link targets, and bare URL lines without trailing dots."""
    bare = F.transform(lines(text), lambda line: F.rtrim(strip(line), F.lit(".")))
    bare = F.filter(bare, lambda line: line.startswith("http://") | line.startswith("https://"))
    return F.regexp_extract_all(text, F.lit(_MARKDOWN_LINK), F.lit(1)), bare


def parse_llms_links(docs: DataFrame) -> DataFrame:
    """``(…, ord, url)`` from ``(…, base, text)``: markdown links resolved against ``base``, then bare lines."""
    marked, bare = llms_link_list(F.col("text"))
    rest = [c for c in docs.columns if c != "text"]
    found = docs.select(*rest, F.size(marked).alias("_marked"), F.posexplode(F.concat(marked, bare)).alias("ord", "_link"))
    url = F.when(F.col("ord") < F.col("_marked"), resolve_url(F.col("base"), F.col("_link"))).otherwise(F.col("_link"))
    return found.select(*rest, F.col("ord").cast("bigint"), url.alias("url"))


def llms_urls(sites: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URL rows of every site with an llms.txt, and the whole-site file where one is named and filled.

    The whole-site URL is chosen before the host filter; when its body is missing or empty only that
    URL is dropped.
    """
    wanted = sites.filter(F.col("adapter").isin("auto", "llmstxt")).withColumn("base", base_of(F.col("url")))
    index = wanted.select("site", "base", F.concat("base", F.lit("/llms.txt")).alias("url"))
    ok = resources.filter(F.col("status") == 200)
    docs = index.join(ok.select("url", F.col("html").alias("text")), "url").select("site", "base", "text")
    urls = written(dedupe_urls(parse_llms_links(docs).drop("base")), "llms")
    named = urls.filter(F.substring_index("url", "/", -1).startswith("llms-full"))
    first = named.groupBy("site").agg(F.min_by("url", "ord").alias("url"))
    full = first.join(ok.filter(F.length("html") > 0).select("url", F.col("html").alias("text")), "url")
    rules = small_side(wanted.select("site", host_of(F.col("url")).alias("origin"), "include_re", "exclude_re"), "rules")
    kept = (urls.join(first, ["site", "url"], "left_anti").join(rules, "site")
            .filter(same_host(F.col("url"), F.col("origin"))
                    & path_allowed(url_path(F.col("url")), F.col("include_re"), F.col("exclude_re"))))
    full = written(full.select("site", "url", "text"), "llms-full")
    kept = kept.join(full.select("site"), "site", "left_anti")
    return kept.select("site", "ord", "url"), full


# sitemaps ------------------------------------------------------------------------------------------

def robots_sitemaps(sites: DataFrame, resources: DataFrame) -> DataFrame:
    """``(site, ord, url)``: the two default sitemap names, then the robots.txt lines, deduplicated."""
    bases = sites.select("site", base_of(F.col("url")).alias("base"))
    default = bases.select("site", F.posexplode(F.array(
        F.concat("base", F.lit("/sitemap.xml")), F.concat("base", F.lit("/sitemap_index.xml")))).alias("ord", "url"))
    robots = resources.filter(F.col("status") == 200).select("url", F.col("html").alias("text"))
    named = (bases.withColumn("url", F.concat("base", F.lit("/robots.txt"))).join(robots, "url")
             .select("site", "base", F.posexplode(lines(F.col("text"))).alias("ord", "line"))
             .filter(F.lower("line").startswith("sitemap:"))
             .select("site", (F.col("ord") + 2).alias("ord"),
                     resolve_url(F.col("base"), strip(F.expr("substr(line, 9)"))).alias("url")))
    return dedupe_urls(default.unionByName(named))


def _digits(position: Column) -> Column:
    return F.lpad(position.cast("string"), _DIGITS, "0")


def sitemap_tree(candidates: DataFrame, sites: DataFrame, resources: DataFrame, guard: int | None = None,
                 children: int | None = None, depth: int | None = None) -> DataFrame:
    """``(site, ord, url)`` of all sitemap files reachable from ``candidates``.

    Every file is parsed once, however many sites or levels meet it; the walk joins the current level with narrow edges.
    ``ord`` is a text key that sorts in visit order: a file's children ('0' + child number) come before its own
    URLs ('1' + position). Every file is read once per site, where it is met first, level by level; so cycles end and
    nothing is left out.

    The limits are off unless asked for: ``children`` followed per file, ``depth`` of the recursion (a file may
    then be read again on another way), and ``guard``: no file is entered once more URLs were collected before it.
    """
    own, edges, names = _sitemap_tables(candidates, resources, children)
    level = candidates.select("site", _digits(F.col("ord")).alias("file"), "url").join(names, "url", "left_semi")
    visited: list[DataFrame] = []
    met = 0
    while True:
        if depth is None:
            level = level.groupBy("site", "url").agg(F.min("file").alias("file"))
            if visited:
                seen = reduce(DataFrame.unionByName, visited).select("site", "url")
                level = level.join(join_side(seen, met, LEVEL_ROWS), ["site", "url"], "left_anti")
        visited.append(written(level.select("site", "file", "url"), "level"))
        size = visited[-1].count()
        if not size or len(visited) - 1 == depth:
            break
        met += size
        level = (join_side(visited[-1], size, LEVEL_ROWS).join(edges, "url")
                 .select("site", F.concat("file", F.lit("0"), _digits(F.col("pos"))).alias("file"), F.col("child").alias("url")))
    urls = (reduce(DataFrame.unionByName, visited).join(own, "url").join(_rules(sites), "site")
            .filter((F.col("host") == F.col("origin")) & _passes())
            .select("site", "file", F.concat("file", F.lit("1"), _digits(F.col("pos"))).alias("ord"), F.col("found").alias("url")))
    return (urls if guard is None else _guarded(written(urls, "sitemap"), guard)).select("site", "ord", "url")


def _sitemap_tables(candidates: DataFrame, resources: DataFrame, children: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the sitemap files say: ``(url, pos, found, host, path)`` of their canonical URLs, ``(url, pos, child)`` of
    the files they name among those stored, and the ``url`` of every file. A file counts by its name, or as a candidate."""
    bodies = resources.filter((F.col("status") == 200) & (F.length("html") > 0)).select("url", "html")
    starts = small_side(candidates.select("url").distinct(), "starts")
    named = _sitemap_name(F.col("url"))
    bodies = bodies.filter(named).unionByName(bodies.filter(~named).join(starts, "url", "left_semi"))
    files = written(bodies.select("url", once(sitemap_locs(F.col("html"))).alias("locs")), "files")
    names = small_side(files.select("url").distinct(), "names")
    own = (files.select("url", F.posexplode("locs").alias("pos", "loc"))
           .select("url", "pos", once(normalize_url(F.col("loc"))).alias("found")).filter(F.col("found").isNotNull()))
    child = F.filter("locs", _sitemap_name)
    child = child if children is None else F.slice(child, 1, children)
    edges = (files.select(F.col("url").alias("file"), F.posexplode(child).alias("pos", "url")).join(names, "url", "left_semi")
             .select(F.col("file").alias("url"), "pos", F.col("url").alias("child")))
    return small_side(with_host_path(own, "found"), "own"), small_side(edges, "edges", LEVEL_ROWS), names


def _guarded(urls: DataFrame, guard: int) -> DataFrame:
    """Drops the URLs of files that would not have been entered; only sites beyond the guard are examined."""
    counts = urls.groupBy("site", "file").agg(F.count("*").alias("n"))
    large = counts.groupBy("site").agg(F.sum("n").alias("total")).filter(F.col("total") > guard)
    counts = counts.join(large.select("site"), "site")
    enter = counts.select("site", "file", F.col("file").alias("at"), F.lit(0).alias("n"))
    leave = counts.select("site", "file", F.concat("file", F.lit("1~")).alias("at"), "n")
    # One row per sitemap file, so a site's window is bounded by its file count.
    seen = F.sum("n").over(Window.partitionBy("site").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    skipped = (enter.withColumn("enter", F.lit(True)).unionByName(leave.withColumn("enter", F.lit(False)))
               .withColumn("seen", seen).filter(F.col("enter") & (F.col("seen") > guard)))
    return urls.join(skipped.select("site", "file"), ["site", "file"], "left_anti")


def subtree_fallback(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """URLs under the start path, else its ancestors, else the start URL, per site."""
    starts = small_side(sites.select("site", F.col("url").alias("start"), url_path(F.col("url")).alias("prefix")), "starts")
    path = url_path(F.col("url"))
    tier = (F.when(F.col("prefix").isin("", "/") | path.startswith(F.col("prefix")), 0)
            .when(F.col("prefix").startswith(path) & (path != "/"), 1))
    tiered = urls.join(starts, "site").select("site", "ord", "url", tier.alias("tier")).filter(F.col("tier").isNotNull())
    listed = urls.select("site").distinct().join(starts, "site")
    start = listed.select("site", F.lit(None).cast(urls.schema["ord"].dataType).alias("ord"),
                          F.col("start").alias("url"), F.lit(2).alias("tier"))
    return best_only(tiered.unionByName(start), "tier").drop("tier")


def expand_seeds(urls: DataFrame, sites: DataFrame, pages: DataFrame,
                 seeds: int | None = SEEDS, per_seed: int | None = None) -> DataFrame:
    """Links of the first ``seeds`` URLs of each site, or of all with None, that pass all checks and were not found before.

    Only the seed pages are read for links. With ``per_seed`` each gives so many new links at most; seeds are then
    taken one after the other, because a link one seed has given is not counted for the next.
    """
    if seeds is None and per_seed is not None:
        raise ValueError("per_seed needs a number of seeds")
    rules = _rules(sites)
    if seeds is None:
        first = rank_in_group(urls.select("site", "ord", "url"), ["site"], ["ord"], "seed")
    else:
        first = rank_rows(top_n(urls, ["site"], ["ord"], seeds), "seed")
    first = small_side(first.withColumnRenamed("url", "src_url").select("site", "seed", "src_url"), "seeds")
    seen = pages.join(first.select(F.col("src_url").alias("url")).distinct(), "url", "left_semi")
    hops = (first.join(link_graph(seen).withColumnRenamed("dst_url", "url"), "src_url").join(rules, "site")
            .filter((F.col("url") != F.col("src_url")) & (host_of(F.col("src_url")) == F.col("origin")))
            .filter(in_subtree(F.col("href"), F.col("path"), prefix_of(F.col("src_url"))) & _passes())
            .groupBy("site", "seed", "url").agg(F.min("pos").alias("pos")))
    ord_ = F.col("seed").cast("bigint") * F.lit(1 << 32) + F.col("pos")
    if per_seed is None:
        return hops.groupBy("site", "url").agg(F.min(ord_).alias("ord")).select("site", "ord", "url")
    hops = written(hops, "hops")
    in_page = Window.partitionBy("site").orderBy("pos")     # one seed at a time: the links of one page
    taken = None
    for number in range(1, seeds + 1):
        new = hops.filter(F.col("seed") == number)
        if taken is not None:
            new = new.join(taken.select("site", "url"), ["site", "url"], "left_anti")
        new = new.withColumn("rank", F.row_number().over(in_page)).filter(F.col("rank") <= per_seed).drop("rank")
        new = written(new, "seed")
        taken = new if taken is None else taken.unionByName(new)
    return taken.select("site", ord_.alias("ord"), "url")


def rank_rows(df: DataFrame, name: str) -> DataFrame:
    """Position by ``ord`` per site, for frames that hold only a few rows per site."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("site").orderBy("ord")))


def sitemap_urls(sites: DataFrame, resources: DataFrame, files: DataFrame, pages: DataFrame, seeds: int | None = SEEDS,
                 per_seed: int | None = None, **limits: int | None) -> DataFrame:
    """Sorted URLs of all sites that have at least one sitemap URL; ``files`` are the :func:`site_files`.

    ``limits`` are those of :func:`sitemap_tree`, ``seeds`` and ``per_seed`` those of :func:`expand_seeds`.
    """
    candidates = written(robots_sitemaps(sites, files), "candidates")
    odd = small_side(candidates.select("url").filter(~_sitemap_name(F.col("url"))).distinct(), "odd")
    if not odd.isEmpty():       # sitemaps robots.txt names freely need one more look at the resources
        files = files.unionByName(written(resources.select("url", "status", "html").join(odd, "url", "left_semi"), "odd-files"))
    tree = sitemap_tree(candidates, sites, files, **limits)
    urls = written(subtree_fallback(dedupe_urls(tree), sites), "subtree")
    expanded = expand_seeds(urls, sites, pages, seeds, per_seed)
    both = union_dedupe(urls, expanded.withColumn("ord", F.lpad(F.col("ord").cast("string"), 20, "0")))
    return sort_urls(both, sites).select("site", "ord", "url")


# crawl graph ---------------------------------------------------------------------------------------

def crawl_graph(sites: DataFrame, links: DataFrame) -> DataFrame:
    """``(site, url, depth, rank)`` reached from each start URL over ``links``, level by level.

    A level is written once and read back, so the plan stays small and a lost executor costs one level.
    Links are stored once in buckets of their source page; each level moves only its frontier. ``rank`` is the
    queue position inside the level for sites that cap their pages, and null for all others, whatever sites run along.
    """
    spark = sites.sparkSession
    ranked = not sites.filter(F.col("max_pages") > 0).isEmpty()
    start = F.coalesce(normalize_url(F.col("url")), F.col("url"))
    starts = sites.select("site", start.alias("start"), host_of(F.col("url")).alias("origin"), "platform",
                          "include_re", "exclude_re", "max_depth", "max_pages")
    # A start URL may lose a default port; its links then never match the site's own host.
    rules = small_side(starts.withColumn("prefix", prefix_of(F.col("start")))
                       .withColumn("at_home", host_of(F.col("start")) == F.col("origin")), "rules")
    root, columns = scratch_path(spark, "crawl"), "site string, url string, rank bigint"
    level = rules.withColumn("path", url_path(F.col("start"))).filter(_passes()).select("site", F.col("start").alias("url"), F.lit(1).cast("bigint").alias("rank"))
    follow = in_subtree(F.col("href"), F.col("path"), F.col("prefix")) & _passes()
    depth = met = 0
    with bucketed(links, "src_url", "graph") as graph:
        while True:
            level.write.parquet(f"{root}/depth={depth}")
            done = spark.read.schema(columns).parquet(f"{root}/depth={depth}")
            seen = spark.read.schema(columns + ", depth int").option("basePath", root).parquet(f"{root}/depth=*")
            size = done.count()
            if not size:
                return seen
            met += size
            level = _next_level(done, size, seen, met, graph, rules, follow, depth, ranked)
            depth += 1


def _next_level(done: DataFrame, size: int, seen: DataFrame, met: int, graph: DataFrame, rules: DataFrame, follow: Column,
                depth: int, ranked: bool) -> DataFrame:
    """URLs first reached from the level ``done``, in queue order where a site is capped (none is unless ``ranked``).

    ``size`` and ``met`` are the rows of ``done`` and ``seen``: neither the graph nor a long list is broadcast per level.
    """
    leaving = (done.withColumnRenamed("url", "src_url").join(rules, "site")
               .filter(((F.col("max_depth") == 0) | (F.col("max_depth") > depth)) & F.col("at_home")))
    # The path checks are held back until the join, else Catalyst makes them on the whole graph at every level.
    hops = (join_side(leaving, size, LEVEL_ROWS).join(graph, "src_url").withColumnRenamed("dst_url", "url")
            .withColumn("_follow", once(follow)).filter("_follow").drop("_follow"))
    order = F.min(F.struct("rank", "pos")) if ranked else F.lit(None)
    capped = F.max("max_pages") > 0
    level = (hops.groupBy("site", "url").agg(order.alias("at"), capped.alias("capped"))
             .join(join_side(seen.select("site", "url"), met, LEVEL_ROWS), ["site", "url"], "left_anti"))
    unranked = F.lit(None).cast("bigint").alias("rank")
    if not ranked:
        return level.select("site", "url", unranked)
    level = written(level, "level")
    free = level.filter(~F.col("capped")).select("site", "url", unranked)
    queued = level.filter("capped").select("site", "url", "at.rank", "at.pos")
    queued = rank_in_group(queued, ["site"], ["rank", "pos"], "next").select("site", "url", F.col("next").alias("rank"))
    return free.unionByName(_capped(queued, seen, rules))


def _capped(level: DataFrame, seen: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of a level that still fit under the page cap of their site."""
    found = small_side(seen.groupBy("site").agg(F.count("*").alias("_found"))
                       .join(rules.select("site", "max_pages"), "site"), "found")
    return (level.join(found, "site")
            .filter((F.col("max_pages") == 0) | (F.col("_found") + F.col("rank") <= F.col("max_pages")))
            .select("site", "url", "rank"))


def crawl_urls(sites: DataFrame, links: DataFrame) -> DataFrame:
    """Sorted URLs of the crawl graph."""
    reached = crawl_graph(sites, links)
    order = F.struct("depth", F.coalesce("rank", F.lit(0)).alias("rank"), "url")
    return sort_urls(reached.select("site", "url", order.alias("ord")), sites).select("site", "ord", "url")


# choice of source ----------------------------------------------------------------------------------

def discover(sites: DataFrame, resources: DataFrame, **limits: int | None) -> tuple[DataFrame, DataFrame]:
    """``(site, ord, url, source)`` and the whole-site files; costlier sources run only for sites still open.

    ``limits`` are those of :func:`sitemap_urls`; without them nothing is left out. The crawl reads links only of pages on the hosts of sites that neither other source has settled.
    """
    files = site_files(resources)
    pages = resources.filter(F.col("status") == 200).select(
        "url", "status", "html", *(c for c in resources.columns if c == "final_url"))
    spark = sites.sparkSession
    found, rest = spark.createDataFrame([], _FOUND), sites.filter(F.col("adapter") != "llmstxt")
    full = spark.createDataFrame([], "site string, url string, text string")
    if not files.isEmpty():     # without such files no site is listed or mapped
        listed, full = llms_urls(sites, files)
        listed = rank_in_group(listed, ["site"], ["ord"], "_pos").withColumn("ord", F.col("_pos")).drop("_pos")
        listed = written(listed.withColumn("source", F.lit("llms.txt")), "listed")
        settled = listed.select("site").union(full.select("site")).distinct()
        open_sites = written(rest.join(settled, "site", "left_anti"), "open")
        mapped = written(sitemap_urls(open_sites, resources, files, pages, **limits).withColumn("source", F.lit("sitemap")), "mapped")
        found = listed.unionByName(mapped)
        rest = open_sites.join(mapped.select("site").distinct(), "site", "left_anti")
    rest = written(rest, "rest")
    if not rest.isEmpty():
        hosts = small_side(rest.select(host_of(F.col("url")).alias("host")).distinct(), "hosts")
        ours = pages.withColumn("host", host_of(F.col("url"))).join(hosts, "host", "left_semi").drop("host")
        found = found.unionByName(crawl_urls(rest, link_graph(ours)).withColumn("source", F.lit("bfs")))
    return prefer_source(found), full
