"""Manifests, run summaries, discovery previews and path collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .ranking import top_n

SHOWN_FAILURES = 10
SHOWN_URLS = 30


def manifest(outcomes: DataFrame, sites: DataFrame, source: DataFrame) -> DataFrame:
    """One row per site: page and failure counts and the time span of its fetches.

    ``outcomes`` carries ``fetched_at``; ``source`` is ``(site, source)``. The URL lists are rows of
    :func:`manifest_urls`, as a list of every URL of a site is unbounded.
    """
    counts = outcomes.groupBy("site").agg(
        F.count_if(F.col("error") == "").alias("pages"), F.count_if(F.col("error") != "").alias("failed"),
        F.min("fetched_at").alias("started_at"), F.max("fetched_at").alias("finished_at"))
    return counts.join(sites, "site").join(source, "site").select(
        F.col("site").alias("name"), "url", "adapter", F.col("site").alias("out_dir"), "pages", "failed",
        "started_at", "finished_at", "source")


def manifest_urls(outcomes: DataFrame) -> DataFrame:
    """URL rows of the manifest: ``list`` is ``urls`` or ``failed_urls``."""
    return outcomes.select("site", F.when(F.col("error") == "", "urls").otherwise("failed_urls").alias("list"),
                           "ord", "url", "error")


def run_summary(outcomes: DataFrame, shown: int = SHOWN_FAILURES) -> DataFrame:
    """Counts per site with its first failures, one row each; ``more`` counts the failures not shown."""
    counts = outcomes.groupBy("site").agg(
        F.count_if(F.col("error") == "").alias("pages"), F.count_if(F.col("error") != "").alias("failed"))
    failures = top_n(outcomes.filter(F.col("error") != "").select("site", "ord", "url", "error"), ["site"], ["ord"], shown)
    return counts.join(failures, "site", "left").select(
        "site", "pages", "failed", "ord", "url", "error",
        F.greatest(F.col("failed") - shown, F.lit(0)).cast("bigint").alias("more"))


def inspect_urls(urls: DataFrame, shown: int = SHOWN_URLS) -> DataFrame:
    """The first URLs of every site with its source and total."""
    totals = urls.groupBy("site", "source").agg(F.count("*").alias("total"))
    return top_n(urls, ["site"], ["ord"], shown).join(totals, ["site", "source"]).select(
        "site", "source", "total", "ord", "url")


def inspect_full(full: DataFrame) -> DataFrame:
    """Preview of whole-site files: the number of characters."""
    return full.select("site", "url", F.length("text").cast("bigint").alias("chars"))


def last_writer(pages: DataFrame) -> DataFrame:
    """Of pages that share an output path the one written last, by ``ord``.

    The overwritten pages are found on narrow rows and removed by an anti join, broadcast when they are few.
    """
    shared = path_collisions(pages).select("site", "path", "kept")
    lost = pages.select("site", "path", "ord").join(shared, ["site", "path"]).filter(F.col("ord") < F.col("kept"))
    return pages.join(small_side(lost.select("site", "path", "ord"), "overwritten"), ["site", "path", "ord"], "left_anti")


def path_collisions(pages: DataFrame) -> DataFrame:
    """Output paths that several URLs map to, with the surviving ``ord``."""
    return (pages.groupBy("site", "path").agg(F.count("*").alias("urls"), F.max("ord").alias("kept"))
            .filter(F.col("urls") > 1))
