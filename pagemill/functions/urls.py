"""URL functions: split, canonicalise, resolve and map to output paths.

All of them are built-in expressions. Only resolving an href that really holds ``.`` or ``..``
segments needs a fold over its segments.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip

# Fixed value: the URI-splitting regex of RFC 3986, appendix B.
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
_LEADING_CONTROLS = "".join(map(chr, range(0x21)))
# A bracketed host is legal only as one IP literal.
_IP_LITERAL = r"^(?:[^\[\]]*@)?\[(?:[0-9A-Fa-f:.%]+|[vV][0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?$"
# Characters whose compatibility form holds one of / ? # @ : and spoofs a host.
_SPOOF = r"[\x{2047}-\x{2049}\x{2100}\x{2101}\x{2105}\x{2106}\x{2a74}\x{fe13}\x{fe16}\x{fe55}\x{fe56}" \
         r"\x{fe5f}\x{fe6b}\x{ff03}\x{ff0f}\x{ff1a}\x{ff1f}\x{ff20}]"

# Query keys that survive canonicalisation.
KEPT_QUERY_KEYS = ("hl", "lang", "version")

# Device names Windows reserves.
_DEVICE_NAMES = "CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]"


class UrlParts(NamedTuple):
    scheme: Column
    netloc: Column
    path: Column
    query: Column


def _cleaned(url: Column) -> Column:
    return F.regexp_replace(F.ltrim(url, F.lit(_LEADING_CONTROLS)), "[\t\r\n]+", "")


def url_parts(url: Column) -> UrlParts:
    """Scheme (lower case), host with port, path and query; '' where absent."""
    # One regex pass for all parts; a cleaned URL holds no newline.
    split = F.split(F.regexp_replace(_cleaned(url), _URI, "$1\n$2\n$3\n$4"), "\n", -1)
    return UrlParts(F.lower(F.get(split, F.lit(0))), *(F.get(split, F.lit(i)) for i in (1, 2, 3)))


def url_path(url: Column) -> Column:
    return url_parts(url).path


def host_of(url: Column) -> Column:
    """Host with port, lower case."""
    return F.lower(url_parts(url).netloc)


def same_host(url: Column, origin: Column) -> Column:
    return host_of(url) == F.lower(origin)


def base_of(url: Column) -> Column:
    """``scheme://host`` of a start URL, scheme as written."""
    return F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url))


def _legal_netloc(netloc: Column) -> Column:
    bracket = netloc.contains("[") | netloc.contains("]")
    ascii_only = F.octet_length(netloc) == F.length(netloc)
    return (~bracket | netloc.rlike(_IP_LITERAL)) & (ascii_only | ~netloc.rlike(_SPOOF))


def normalize_url(url: Column) -> Column:
    """Canonical http(s) URL, or null. No costly part is named twice below the condition."""
    scheme, netloc, path, query = url_parts(strip(url))
    origin = F.regexp_replace(F.concat(scheme, F.lit("://"), F.lower(netloc)),
                              r"\A(http://.*):80\z|\A(https://.*):443\z", "$1$2")
    trimmed = F.rtrim(F.regexp_replace(path, r"/index\.(?:html?|md)\z", "/"), F.lit("/"))
    kept = F.regexp_extract_all(
        F.concat(F.lit("&"), query), F.lit(f"(&(?:{'|'.join(KEPT_QUERY_KEYS)})=[^&]+)"), F.lit(1))
    return F.when(
        scheme.isin("http", "https") & (netloc != "") & _legal_netloc(netloc),
        # the greater of '/' and a path: '/' only for the empty one
        F.concat(origin, F.greatest(trimmed, F.lit("/")), F.regexp_replace(F.array_join(kept, ""), r"\A&", "?")),
    )


def url_ext(url: Column) -> Column:
    """Lower-case extension of the last path segment with its dot, or ''."""
    return path_ext(url_path(url))


def path_ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*\z", 0))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from the page ``base``.

    One expression for few rows; ``operators.links.resolve`` takes the same steps column by column.
    """
    b, h = url_parts(base), url_parts(href)
    path = joined_path(b, h)
    return assembled(b, h, base, href, F.when(has_dots(path), without_dots(path)).otherwise(path))


def joined_path(base: UrlParts, href: UrlParts) -> Column:
    """Path of a relative link below the folder of the base, dots still in it."""
    folder = F.regexp_replace(base.path, r"[^/]*\z", "")
    return F.when(href.path.startswith("/"), href.path).otherwise(
        F.regexp_replace(F.concat(folder, href.path), "/{2,}", "/"))


def has_dots(path: Column) -> Column:
    return path.contains(".") & path.rlike(r"(?:^|/)\.\.?(?:/|\z)")


def assembled(base: UrlParts, href: UrlParts, base_url: Column, href_text: Column, path: Column) -> Column:
    """The absolute URL from both parts and the joined path."""
    def marked(query: Column) -> Column:
        return F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))

    fragment = F.when(href_text.contains("#"), F.regexp_extract(_cleaned(href_text), r"(?s)#.+", 0)).otherwise("")
    tail = F.concat(marked(href.query), fragment)
    origin = F.concat(base.scheme, F.lit("://"), base.netloc)
    own_page = F.concat(origin, base.path, F.when(href.query == "", marked(base.query)).otherwise(marked(href.query)), fragment)
    other_host = F.concat(base.scheme, F.lit("://"), href.netloc, F.when(href.path == "", "").otherwise(_rooted(href.path)), tail)
    return (F.when(href_text == "", base_url)
            .when((href.scheme != "") & (href.scheme != base.scheme), href_text)
            .when(href.netloc != "", other_host)
            .when(href.path == "", own_page)
            .otherwise(F.concat(origin, _rooted(path), tail)))


def _rooted(path: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments folded away."""
    segments = F.split(path, "/", -1)
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, seg: F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(seg == ".", done).otherwise(F.array_append(done, seg)))
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    return F.array_join(F.concat(folded, tail), "/")


def rel_path(url: Column) -> Column:
    """Output path, without extension, that mirrors the URL path; every segment is a safe file name, uncut."""
    path = F.regexp_replace(url_path(url), r"(?i)\.(?:html?|md|xhtml|txt)\z", "")
    path = F.btrim(F.regexp_replace(path, "/{2,}", "/"), F.lit("/"))
    path = F.regexp_replace(path, r"(?i)(?<=[^/])/index(?:\.htm)?\z", "")
    path = F.regexp_replace(path, r'[<>:"\\|?*\x{0}-\x{1f}]', "_")
    path = F.regexp_replace(path, f"(?<![^/])[{SPACE}]+|[{SPACE}]+(?![^/])", "")
    path = F.regexp_replace(path, r"[. ]+(?![^/])", "")
    path = F.regexp_replace(path, r"(?<![^/])(?![^/])", "index")
    return F.regexp_replace(path, rf"(?i)(?<![^/])(?=(?:{_DEVICE_NAMES})(?![^/]))", "_")


def site_name(name: Column, url: Column) -> Column:
    """Explicit name, else the host as written with ``:`` replaced by ``_``."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    host = F.replace(F.substring_index(rest, "/", 1), F.lit(":"), F.lit("_"))
    return F.coalesce(F.nullif(name, F.lit("")), host)


def text_page_title(url: Column) -> Column:
    """Last ``/`` part of the URL, query included, without its last extension."""
    return F.regexp_replace(F.substring_index(url, "/", -1), r"(?s)\.[^.]*\z", "")
