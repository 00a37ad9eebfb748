"""Stored resources to page rows: kind, extraction and outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pages import is_html, outcome_error
from ..functions.platforms import is_shell
from ..functions.text import strip
from ..functions.urls import rel_path, text_page_title
from ..session import small_side
from .extract import extract_pages

_COLUMNS = ["url", "path", "status", "title", "markdown", "toc", "meta", "error", "needs_render",
            "fetched_at"]
_KEYS = ["site", "ord"]


def site_pages(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Page rows of the ``(site, ord, url, platform)`` wanted. A stored page is parsed once for each platform and then
    dealt to the sites that list it; the list of these sites (names and positions only) travels with its URL."""
    listed = wanted.groupBy("url", "platform").agg(F.collect_list(F.struct(*_KEYS)).alias("_listed"))
    parsed = page_outcome(resources.join(small_side(listed, "wanted"), "url"), ["_listed"])
    return parsed.select(F.inline("_listed"), *_COLUMNS)


def page_outcome(pages: DataFrame, keys: list[str] = _KEYS) -> DataFrame:
    """Page rows for ``(*keys, url, status, html, fetched_at, platform)``; ``error`` is '' for pages that made it.

    Only HTML bodies with status 200 reach the parser: for all other rows it gets a null.
    """
    page = pages.withColumn("_body", F.coalesce("html", F.lit(""))).withColumn("_is_html", is_html(F.col("_body")))
    ok, parse = F.col("status") == 200, (F.col("status") == 200) & F.col("_is_html")
    page = extract_pages(page.withColumn("html", F.when(parse, F.col("_body"))))
    text_page = ok & ~F.col("_is_html")
    markdown = F.when(text_page, strip(F.col("_body"))).otherwise(F.coalesce("markdown", F.lit("")))
    none = F.create_map().cast("map<string,string>")
    return (page.withColumn("markdown", F.when(ok, markdown).otherwise(""))
            .withColumn("title", F.when(text_page, text_page_title(F.col("url")))
                        .when(ok, F.coalesce("title", F.lit(""))).otherwise(""))
            .withColumn("meta", F.when(text_page, F.create_map(F.lit("url"), F.col("url"), F.lit("format"), F.lit("text")))
                        .when(ok, F.coalesce("meta", none)).otherwise(none))
            .withColumn("toc", F.coalesce("toc", F.array().cast("array<struct<level:int,title:string,anchor:string>>")))
            .withColumn("path", rel_path(F.col("url")))
            .withColumn("error", outcome_error(F.col("status"), F.col("_is_html"), F.col("markdown"), F.col("failure")))
            .withColumn("needs_render", (F.col("error") != "") & ok & is_shell(F.col("_body")))
            .select(*keys, *_COLUMNS))
