"""Documentation platforms: fixed rules and detection from the page head."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPHINX_NOISE = ["/_sources/", "/_static/", "/genindex", "/py-modindex", "/search", "/objects.inv", "/.doctrees"]
_SPHINX_ROOTS = ("[role='main']", "div.document", ".body")

# Noise path parts per platform.
NOISE: dict[str, list[str]] = {
    "sphinx": _SPHINX_NOISE,
    "readthedocs": _SPHINX_NOISE,
    "docusaurus": ["/search", "/tags/", "/assets/", "/img/"],
    "mkdocs": ["/search.html", "/404.html", "/sitemap.xml"],
    "gitbook": ["/~gitbook/", "/search"],
    "vuepress": ["/assets/", "/search"],
    "hugo": ["/tags/", "/categories/"],
}

# Content selectors per platform, best first.
SELECTORS: dict[str, tuple[str, ...]] = {
    "sphinx": _SPHINX_ROOTS,
    "readthedocs": _SPHINX_ROOTS,
    "docusaurus": ("article", "main .theme-doc-markdown", ".markdown"),
    "mkdocs": ("[role='main']", "article", ".md-content__inner"),
    "gitbook": ("main", ".book-body .page-inner", ".markdown-section"),
    "vuepress": ("main", ".theme-default-content", ".content__default"),
    "hugo": ("article", "main", ".content"),
}

# Every known adapter; other names behave like "generic".
ADAPTERS = ("generic", "llmstxt", *NOISE)

# Markers of a page that only a script fills.
SHELL_MARKERS = ('id="app"', 'id="root"', "__NUXT__", "__NEXT_DATA__", "window.__INITIAL_STATE__")

# Generator names in order of precedence, then DOM hints in order of precedence.
_GENERATORS = (("docusaurus", "docusaurus"), ("gitbook", "gitbook"), ("mkdocs", "mkdocs"), ("sphinx", "sphinx"),
               ("vuepress", "vuepress"), ("hugo", "hugo"), ("jupyter-book", "sphinx"))
_DOM_HINTS = (
    ("docusaurus", ('class="theme-doc-markdown"', "theme-doc-")),
    ("gitbook", ('class="book-body"', 'data-type="book"')),
    ("readthedocs", ('class="rst-content"', 'class="wy-nav-content"')),
    ("mkdocs", ('class="md-content__inner"',)),
    ("vuepress", ('class="theme-default-content"',)),
    ("sphinx", ("data-content_root", 'class="document"', "[role='main']")),
)
_BODY = "(?i)<body"
_GENERATOR = r"""(?i)<meta[^>]+name=["']generator["'][^>]+content=["']([^"']+)"""


def detect_platform(html: Column, url: Column, limit: int | None = None) -> Column:
    """Adapter name from the generator tag, else from DOM hints, else ``generic``.

    The whole page is read, or its first ``limit`` characters; a host's name counts only before the body.
    """
    page, where = html if limit is None else F.substring(html, 1, limit), F.lower(url)
    head = F.get(F.split(page, _BODY, 2), F.lit(0))
    generator = F.lower(F.regexp_extract(page, _GENERATOR, 1))
    hosted = where.contains("readthedocs") | where.contains("rtd")
    rules = []
    for word, adapter in _GENERATORS:
        result = F.when(hosted, "readthedocs").otherwise(adapter) if word == "sphinx" else F.lit(adapter)
        rules.append((generator.contains(word), result))
    rules.append((head.contains("readthedocs") | where.contains("readthedocs"), F.lit("readthedocs")))
    for adapter, marks in _DOM_HINTS:
        rules.append((reduce(lambda a, b: a | b, (page.contains(m) for m in marks)), F.lit(adapter)))
    case = F.when(*rules[0])
    for condition, result in rules[1:]:
        case = case.when(condition, result)
    return case.otherwise("generic")


def known_adapter(name: Column) -> Column:
    return F.when(name.isin(list(ADAPTERS)), name).otherwise("generic")


def selectors_of(adapter: Column) -> Column:
    """The adapter's content selectors, best first; empty for adapters without any."""
    case = F
    for name, selectors in SELECTORS.items():
        case = case.when(adapter == name, F.array(*map(F.lit, selectors)))
    return case.otherwise(F.array().cast("array<string>"))


def is_shell(html: Column) -> Column:
    """True for pages that look like an empty script container."""
    return reduce(lambda a, b: a | b, (html.contains(m) for m in SHELL_MARKERS))
