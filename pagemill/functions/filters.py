"""URL predicates: static assets, noise paths and include/exclude rules."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .platforms import NOISE
from .text import strip
from .urls import host_of, normalize_url, path_ext, resolve_url, url_path

# Extensions of static assets and data files.
ASSET_EXTENSIONS = [
    ".pdf", ".zip", ".gz", ".tar", ".7z", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".css", ".js",
    ".woff", ".woff2", ".mp4", ".webm", ".mp3", ".exe", ".msi", ".dmg", ".iso", ".rss", ".xml", ".json", ".yaml",
    ".yml", ".md", ".txt", ".csv", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]

# Path parts that mark pages without content.
NOISE_PARTS = [
    "/search", "/login", "/signup", "/account", "/cart", "/checkout", "/feed", "/rss", "/atom", "/wp-", "/xmlrpc",
    "/trackback", "/privacy", "/terms",
]

# Paths excluded for every site (globs without wildcards, so exact paths).
DEFAULT_EXCLUDES = [
    "/search", "/tags", "/categories", "/feed", "/rss", "/atom", "/404", "/login", "/signup", "/account", "/admin",
    "/logout", "/_sources", "/_static", "/objects.inv", "/genindex", "/py-modindex", "/~gitbook", "/sitemap",
]


def contains_any(text: Column, parts) -> Column:
    return text.rlike("|".join(map(re.escape, parts)))


def is_asset(path: Column) -> Column:
    return path_ext(path).isin(ASSET_EXTENSIONS)


def is_noise(path: Column) -> Column:
    return contains_any(path, NOISE_PARTS)


def is_platform_noise(adapter: Column, path: Column) -> Column:
    """Noise by the adapter's own path parts: a fixed rule set, so a CASE and not a join."""
    return reduce(or_, ((adapter == name) & contains_any(path, parts) for name, parts in NOISE.items()))


def path_allowed(path: Column, include_re: Column, exclude_re: Column) -> Column:
    """Include/exclude rules given as anchored regexes (see ``glob_regex``); null means no rule."""
    included = include_re.isNull() | F.rlike(path, include_re)
    excluded = path.isin(DEFAULT_EXCLUDES) | F.coalesce(F.rlike(path, exclude_re), F.lit(False))
    return included & ~excluded


def path_passes(path: Column, adapter: Column, include_re: Column, exclude_re: Column,
                allow_md: bool = False) -> Column:
    """The composite check on the path of every discovered URL; ``allow_md`` skips the extension test.

    ``path`` is named by some forty tests, so it should be a column and not an expression.
    """
    keep = ~is_platform_noise(adapter, path) & ~is_noise(path) & path_allowed(path, include_re, exclude_re)
    return keep if allow_md else keep & ~is_asset(path)


def prefix_of(url: Column) -> Column:
    """URL path used as a subtree prefix; the root path means no prefix."""
    path = url_path(url)
    return F.when(path == "/", "").otherwise(path)


def in_subtree(href: Column, path: Column, prefix: Column) -> Column:
    """True when a link with this ``path`` may be followed from within ``prefix``.

    Links written absolute must stay below the prefix; links written relative may leave it, except to
    the root page.
    """
    written_absolute = href.startswith("http://") | href.startswith("https://")
    return F.when(written_absolute, path.startswith(prefix)).otherwise((prefix == "") | (path != "/"))


def candidate_from_href(href: Column, base: Column, origin: Column, prefix: Column) -> Column:
    """Canonical target of a link when it stays on the host and in the subtree, else null."""
    href = strip(href)
    canonical = normalize_url(resolve_url(base, href))
    same = host_of(canonical) == F.lower(origin)
    return F.when(same & in_subtree(href, url_path(canonical), prefix), canonical)
