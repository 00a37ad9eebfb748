"""URL lists per site: dedupe, order, cap, choice of source, and work still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..functions.urls import normalize_url, url_path
from ..session import small_side
from .ranking import rank_in_group


def dedupe_urls(urls: DataFrame) -> DataFrame:
    """Canonical URLs, first occurrence by ``ord``; a hash aggregate with map-side combine."""
    return (urls.withColumn("url", once(normalize_url(F.col("url")))).filter(F.col("url").isNotNull())
            .groupBy("site", "url").agg(F.min("ord").alias("ord")))


def union_dedupe(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first`` then ``second``, deduplicated; ``ord`` becomes (list number, ord)."""
    def tagged(df: DataFrame, number: int) -> DataFrame:
        return df.select("site", "url", F.struct(F.lit(number).alias("list"), F.col("ord").alias("at")).alias("ord"))
    return dedupe_urls(tagged(first, 0).unionByName(tagged(second, 1)))


def with_sort_keys(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds the ordering keys: outside the start path, depth, path."""
    starts = small_side(sites.select("site", url_path(F.col("url")).alias("_start")), "starts")
    path = F.col("path")
    return (urls.join(starts, "site").withColumn("path", url_path(F.col("url")))
            .withColumn("outside", F.when((F.col("_start") == "/") | path.startswith(F.col("_start")), 0).otherwise(1))
            .withColumn("depth", F.length("path") - F.length(F.replace(path, F.lit("/"), F.lit(""))))
            .drop("_start"))


def sort_urls(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Replaces ``ord`` by the position in start-subtree-first, shallow-first, path order."""
    ranked = rank_in_group(with_sort_keys(urls, sites), ["site"], ["outside", "depth", "path", "ord"], "pos")
    return ranked.withColumn("ord", F.col("pos")).drop("pos")


def top_pages(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Keeps the first ``max_pages`` of every site; 0 keeps all."""
    caps = small_side(sites.filter(F.col("max_pages") > 0).select("site", "max_pages"), "caps")
    return (urls.join(caps, "site", "left")
            .filter(F.col("max_pages").isNull() | (F.col("ord") <= F.col("max_pages"))).drop("max_pages"))


def best_only(df: DataFrame, rank: str) -> DataFrame:
    """Rows whose ``rank`` is the least of their site: one partial aggregate and a join, no window."""
    best = small_side(df.groupBy("site").agg(F.min(rank).alias("_best")), "best")
    return df.join(best, "site").filter(F.col(rank) == F.col("_best")).drop("_best")


def prefer_source(urls: DataFrame) -> DataFrame:
    """Of several discovery sources per site keep the best: llms.txt, then sitemap, then bfs."""
    order = F.array_position(F.array(*map(F.lit, ("llms.txt", "sitemap", "bfs"))), F.col("source"))
    return best_only(urls.withColumn("_source", order), "_source").drop("_source")


def undiscovered(sites: DataFrame, urls: DataFrame) -> DataFrame:
    """Sites without a single discovered URL."""
    return sites.join(urls.select("site").distinct(), "site", "left_anti")


def frontier(urls: DataFrame, cache: DataFrame, fresh: bool = False) -> DataFrame:
    """Discovered URLs that have no usable cached page."""
    if fresh:
        return urls
    return urls.join(cache.filter(F.length("html") > 0).select("url"), "url", "left_anti")


def first_pages(pages: DataFrame) -> DataFrame:
    """Page rows, ``url`` canonical, without later copies of a URL (order: ``ord``); other URLs are dropped.

    The body never takes part in the aggregate: the ids of the copies are found on narrow rows and removed
    by an anti join, broadcast when the copies are few.
    """
    canonical = pages.withColumn("url", once(normalize_url(F.col("url")))).filter(F.col("url").isNotNull())
    narrow = canonical.select("site", "url", "ord")
    repeated = (narrow.groupBy("site", "url").agg(F.min("ord").alias("_kept"), F.count("*").alias("_n"))
                .filter(F.col("_n") > 1).select("site", "url", "_kept"))
    copies = narrow.join(repeated, ["site", "url"]).filter(F.col("ord") != F.col("_kept")).select("site", "ord")
    return canonical.join(small_side(copies, "copies"), ["site", "ord"], "left_anti")
