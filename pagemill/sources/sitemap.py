"""Sitemap files: the ``<loc>`` values of one document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments are no text; CDATA sections are kept, but one without an end takes the rest of the file.
_COMMENT = r"(?s)(<!\[CDATA\[.*?\]\]>)|<!(?:--.*?-->|(?:--|\[CDATA\[).*\z)"
_ROOT = r"\A\x{feff}?[^<]*+(?:<[?!][^<]*+)*+<([^\s/<>!?]++)"
_LAST = r"</([^\s/<>]++)\s*+>\s*+\z"
_LOC = r"(?s)<((?:[^\s/<>:!?]++:)?loc(?:\s[^<>]*+)?+(?<!/)>[^<]*+(?:<!\[CDATA\[.*?\]\]>[^<]*+)*+)"
_REFERENCE = r"\A(x[0-9a-fA-F]{1,6}|[0-9]{1,7});"

# The named references of XML; the ampersand comes last.
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _utf8(point: Column) -> Column:
    """The character of a code point; null for surrogates and what lies beyond Unicode."""
    def low(shift: int) -> Column:
        return F.shiftright(point, shift).bitwiseAND(F.lit(63))
    two = 0xC080 + F.shiftright(point, 6) * 256 + low(0)
    three = 0xE08080 + F.shiftright(point, 12) * 65536 + low(6) * 256 + low(0)
    four = 0xF0808080 + F.shiftright(point, 18) * 16777216 + low(12) * 65536 + low(6) * 256 + low(0)
    code = (F.when(point < 0x80, point).when(point < 0x800, two)
            .when((point < 0xD800) | point.between(0xE000, 0xFFFF), three).when(point.between(0x10000, 0x10FFFF), four))
    return F.unhex(F.lpad(F.hex(code.cast("bigint")), F.greatest(F.length(F.hex(code.cast("bigint"))), F.lit(2)), F.lit("0"))).cast("string")


def _numbered(piece: Column, no: Column) -> Column:
    """What follows a ``&#``, its number replaced by the character; the ampersand's stays a reference."""
    def spelled(digits: Column) -> Column:
        point = F.when(digits.startswith("x"), F.conv(F.substr(digits, F.lit(2)), 16, 10)).otherwise(digits).try_cast("bigint")
        char = F.when(point == 38, F.lit("&amp;")).otherwise(_utf8(point))
        return F.coalesce(F.concat(char, F.substr(piece, F.length(digits) + 2)), F.concat(F.lit("&#"), piece))
    return F.when(no == 0, piece).otherwise(_let(F.regexp_extract(piece, _REFERENCE, 1), spelled))


def xml_text(text: Column) -> Column:
    """Character and XML's own entity references decoded; any other ampersand stays."""
    decoded = F.array_join(F.transform(F.split(text, "&#", -1), _numbered), "")
    for name, char in _NAMED.items():
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    return F.when(text.contains("&"), decoded).otherwise(text)


def _section(piece: Column, no: Column) -> Column:
    """Text behind the start of a CDATA section: its content as it is, then plain text again."""
    def joined(raw: Column) -> Column:
        return F.concat(raw, xml_text(F.substr(piece, F.length(raw) + 4)))
    return F.when(no == 0, xml_text(piece)).otherwise(_let(F.substring_index(piece, "]]>", 1), joined))


def sitemap_locs(body: Column) -> Column:
    """Array of loc values, in the file's order, of elements with the root element's prefix; empty ones are left out.

    No parser runs: comments are removed, then tags are found by patterns that read the file once. A file counts when
    it ends with its root's end tag, so one cut short, a page of HTML without it, plain text, null and empty give none.
    Faults inside a whole file (a bare ``&``, an element left open) cost nothing but what they touch; entities a file
    declares itself stay as written, and two prefixes of one namespace are told apart.
    """
    def locs(text: Column) -> Column:
        return _let(F.regexp_extract(text, _ROOT, 1), lambda root: F.when(
            (root != "") & (F.regexp_extract(text, _LAST, 1) == root), found(text, F.regexp_extract(root, r"\A[^:]*:", 0))
        ).otherwise(F.array().cast("array<string>")))

    def found(text: Column, prefix: Column) -> Column:
        tags = F.regexp_extract_all(text, F.lit(_LOC), F.lit(1))
        own = F.filter(tags, lambda t: F.regexp_extract(t, r"\A[^\s>]*", 0) == F.concat(prefix, F.lit("loc")))
        return F.filter(F.transform(own, content), lambda t: t != "")

    def content(tag: Column) -> Column:
        inner = F.substr(tag, F.instr(tag, ">") + 1)
        return F.array_join(F.transform(F.split(inner, r"<!\[CDATA\[", -1), _section), "")

    return _let(F.regexp_replace(F.coalesce(body, F.lit("")), _COMMENT, "$1"), locs)
