"""The whole run for many sites: discovery, pages, chunks, documents and manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.chunking import corpus_rows
from ..operators.discovery import discover, site_platform
from ..operators.frontier import frontier, top_pages, undiscovered
from ..operators.outcome import site_pages
from ..operators.reports import manifest, manifest_urls
from ..schemas import TOC
from ..session import written
from ..sources import sinks


@dataclass
class Harvest:
    sites: DataFrame        # adapter: the one in force
    urls: DataFrame         # site, ord, url, source
    todo: DataFrame         # discovered URLs that still need a good fetch
    undiscovered: DataFrame
    pages: DataFrame        # written page rows, failed ones included
    chunks: DataFrame
    manifest: DataFrame
    manifest_urls: DataFrame


def inspect_sites(sites: DataFrame, resources: DataFrame, **limits: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Discovery only: sites with platform, URLs, whole-site files. Extraction is never planned.

    ``limits`` are those of :func:`discover`.
    """
    sites = written(site_platform(sites, resources), "sites")
    urls, full = discover(sites, resources, **limits)
    return sites, written(urls, "urls"), full


def harvest(sites: DataFrame, resources: DataFrame, **limits: int | None) -> Harvest:
    """All tables of a run. Page rows are written once, so later outputs never parse HTML again.

    ``limits`` are those of :func:`discover`, for example ``seeds=None`` to follow the links of every listed page by one hop.
    """
    sites, urls, full = inspect_sites(sites, resources, **limits)
    capped = top_pages(urls, sites)
    outcomes = site_pages(resources, capped.join(sites.select("site", "platform"), "site").drop("source"))
    pages = written(outcomes.unionByName(_whole_site_pages(full, sites)), "pages")
    source = urls.select("site", "source").distinct().union(
        full.select("site", F.lit("llms.txt").alias("source"))).distinct()
    whole = full.select("site", F.lit("llmstxt").alias("_whole"))
    named = sites.join(whole, "site", "left").withColumn("adapter", F.coalesce("_whole", "platform")).drop("_whole")
    return Harvest(
        sites=named, urls=urls, todo=frontier(capped, resources.filter(F.col("status") == 200)),
        undiscovered=undiscovered(sites, urls.select("site").union(full.select("site"))),
        pages=pages, chunks=corpus_rows(pages),
        manifest=manifest(pages, named, source),
        manifest_urls=manifest_urls(pages))


def _whole_site_pages(full: DataFrame, sites: DataFrame) -> DataFrame:
    """The single page of each site that serves its whole content as one file."""
    starts = sites.select("site", F.col("url").alias("start"))
    return full.join(starts, "site").select(
        "site", F.lit(1).cast("bigint").alias("ord"), "url", F.lit("index").alias("path"), F.lit(200).alias("status"),
        F.col("site").alias("title"), strip(F.col("text")).alias("markdown"),
        F.array().cast(TOC).alias("toc"),
        F.create_map(F.lit("url"), F.col("start"), F.lit("format"), F.lit("llms-full.txt")).alias("meta"),
        F.lit("").alias("error"), F.lit(False).alias("needs_render"), F.lit(None).cast("double").alias("fetched_at"))


def write_outputs(run: Harvest, out: str, generated_at: str) -> None:
    """Writes, per site, the formats its settings ask for."""
    def wanting(fmt: str) -> DataFrame:
        chosen = run.sites.filter(F.array_contains("formats", fmt)).select("site")
        return run.pages.join(chosen, "site", "left_semi")

    chosen_json = (run.sites.filter(F.array_contains("formats", "json"))
                   .join(run.pages.select("site").distinct(), "site", "left_semi"))
    sinks.write_by_site(sinks.markdown_files(wanting("md"), run.sites), f"{out}/md", ["path"])
    sinks.write_by_site(sinks.page_json(wanting("json")), f"{out}/json", ["path"])
    sinks.write_site_documents(sinks.site_json(wanting("json"), chosen_json, generated_at), f"{out}/corpus_json")
    sinks.write_corpus(corpus_rows(wanting("jsonl")), f"{out}/corpus_jsonl")
    sinks.write_site_documents(sinks.site_markdown(wanting("jsonl")), f"{out}/corpus_md")
    sinks.write_manifest(run.manifest, run.manifest_urls, f"{out}/manifest")
