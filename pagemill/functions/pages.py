"""Page-level expressions: titles, description, page kind and outcome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, decode_entities, strip

# Fixed value: characters that may separate a page title from a site name.
_TITLE_SEPARATOR = rf"[{SPACE}]*[|\x{{b7}}\x{{2013}}\x{{2014}}:\-][{SPACE}]*"
_DESCRIPTION = r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)"""

# A body with one of these among its first characters is HTML.
_HTML_MARKS = ("<html", "<!doctype", "<head")
_MARK_CHARS = 512
# One of them behind blanks, comments and processing instructions of any length.
_OPENING = rf"(?is)\A(?:[{SPACE}\x{{feff}}]++|<!--.*?-->|<\?.*?>)*+(?:{'|'.join(_HTML_MARKS)})"

EMPTY_EXTRACTION = "empty extraction"


def page_title(html: Column) -> Column:
    """Text of the first title element, trimmed, then with entities decoded; '' when there is none."""
    inner = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return decode_entities(strip(F.regexp_replace(inner, "<[^>]+>", "")))


def clean_title(title: Column) -> Column:
    """The title without its site-name suffix, when the separated parts look like one."""
    parts = F.split(title, _TITLE_SEPARATOR, -1)
    n, first, last = F.size(parts), F.element_at(parts, 1), F.element_at(parts, -1)
    suffix = (n >= 3) | (F.length(last) < F.length(first)) | (
        (F.length(first) <= 12) & (F.length(last) > F.length(first) * 1.5))
    return F.when((n > 1) & (F.length(last) <= 40) & suffix, strip(first)).otherwise(title)


def description(html: Column, limit: int | None = None) -> Column:
    """Content of the description tag (its first ``limit`` characters where given), or null."""
    found = F.regexp_extract(html, _DESCRIPTION, 1)
    return F.nullif(found if limit is None else F.substring(found, 1, limit), F.lit(""))


def page_meta(url: Column, html: Column) -> Column:
    found = description(html)
    return F.when(found.isNull(), F.create_map(F.lit("url"), url)).otherwise(
        F.create_map(F.lit("url"), url, F.lit("description"), found))


def is_html(body: Column) -> Column:
    """A mark stands among the first characters, or opens the body after comments. Marks further on may be quoted text."""
    head = F.lower(F.substring(body, 1, _MARK_CHARS))
    return body.rlike(_OPENING) | head.contains(_HTML_MARKS[0]) | head.contains(_HTML_MARKS[1]) | head.contains(_HTML_MARKS[2])


def outcome_error(status: Column, html_page: Column, markdown: Column, failure: Column) -> Column:
    """'' for a page that made it, else the reason it failed; ``failure`` is an unexpected error or null."""
    return (F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string")))
            .when(html_page & (markdown == ""), F.coalesce(failure, F.lit(EMPTY_EXTRACTION)))
            .otherwise(""))
