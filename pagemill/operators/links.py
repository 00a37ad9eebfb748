"""The link graph: anchors of every page, resolved and canonicalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entity_list, once, strip
from ..functions.urls import (UrlParts, assembled, has_dots, host_of, joined_path, normalize_url, url_parts, url_path,
                              without_dots)

# Without its end, a comment, script or style goes on to the end of the page.
_HIDDEN = r"(?is)<(?:!--.*?(?:-->|\z)|script\b.*?(?:</script\s*+>|\z)|style\b.*?(?:</style\s*+>|\z))"
# Attributes are walked one by one, quoted values whole, up to the first href.
_OTHER = r"""(?!href[\s=>/])[^\s=>/"'<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?+"""
_HREF = rf"""(?is)<a(?=[\s/])(?:[\s/]*+{_OTHER})*+[\s/]*+href\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']+)"""


def extract_links(pages: DataFrame) -> DataFrame:
    """``(src_url, pos, href)`` for every ``<a href>`` in document order, from 0.

    Pages that were redirected name their last address in ``final_url``, which may be null; it is passed on.
    """
    moved = [c for c in pages.columns if c == "final_url"]
    hrefs = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, ""), F.lit(_HREF), F.lit(1))
    # The list is a column of its own before Python sees it, else both patterns would run again around the call.
    return (pages.select(F.col("url").alias("src_url"), *moved, once(hrefs).alias("hrefs"))
            .withColumn("hrefs", once(decode_entity_list(F.col("hrefs"))))
            .select("src_url", *moved, F.posexplode("hrefs").alias("pos", "href"))
            .withColumn("href", F.regexp_replace("href", r"""^["']|["']\z""", "")))


def resolve_links(links: DataFrame) -> DataFrame:
    """Adds ``abs_url`` (resolved against the page's last address) and ``dst_url`` (canonical, or null)."""
    links, base = links.withColumn("_href", strip(F.col("href"))), "src_url"
    if "final_url" in links.columns:
        links, base = links.withColumn("_base", F.coalesce("final_url", "src_url")).drop("final_url"), "_base"
    links = resolve(links, base, "_href", "abs_url").drop("_href", "_base")
    return links.withColumn("dst_url", once(normalize_url(F.col("abs_url"))))


def resolve(df: DataFrame, base: str, href: str, out: str) -> DataFrame:
    """Adds ``out``: the URL column ``href`` made absolute against the URL column ``base``.

    Each step is a column of its own, so that no step repeats an earlier one, and only the fold over dot
    segments leaves generated code.
    """
    b, h, path = _unpacked("_b"), _unpacked("_h"), F.col("_path")
    return (df.withColumn("_b", once(_packed(base))).withColumn("_h", once(_packed(href)))
            .withColumn("_path", once(joined_path(b, h)))
            .withColumn("_dotted", once(F.when(has_dots(path), path)))
            .withColumn("_path", once(F.coalesce(without_dots(F.col("_dotted")), path)))
            .withColumn(out, once(assembled(b, h, F.col(base), F.col(href), path)))
            .drop("_b", "_h", "_path", "_dotted"))


def _packed(url: str) -> Column:
    return F.struct(*(part.alias(name) for name, part in zip(UrlParts._fields, url_parts(F.col(url)))))


def _unpacked(name: str) -> UrlParts:
    return UrlParts(*(F.col(f"{name}.{field}") for field in UrlParts._fields))


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` and ``path`` of a URL column, computed once."""
    parts = F.struct(host_of(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    return df.withColumn("_p", once(parts)).select("*", "_p.host", "_p.path").drop("_p")


def link_graph(pages: DataFrame) -> DataFrame:
    """``(src_url, pos, href, dst_url, path)``: links between pages of one host.

    Only pages fetched with status 200 count. ``path`` is that of ``dst_url``; links to other hosts never
    become candidates, so they are not kept.
    """
    found = resolve_links(extract_links(pages.filter(F.col("status") == 200))).filter(F.col("dst_url").isNotNull())
    return (with_host_path(found, "dst_url").filter(F.col("host") == host_of(F.col("src_url")))
            .select("src_url", "pos", strip(F.col("href")).alias("href"), "dst_url", "path"))
