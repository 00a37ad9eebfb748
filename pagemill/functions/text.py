"""Whitespace, token and entity helpers shared by every operator."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes, as text and as a regex class body.
SPACE_CHARS = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
SPACE = (r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")

# The code-point ranges counted as one token each (kana, CJK, Hangul).
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"

# Fixed value: one overlap unit.
TAIL_UNIT = rf"[{CJK}]|[A-Za-z0-9_]+|[^\n]"

# Fixed value: everything but a newline that Python's splitlines() treats as a line end.
LINE_END = r"[\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def once(value: Column) -> Column:
    """``value`` computed in its own projection.

    Catalyst copies a deterministic expression into the filters above it (also the one it infers for
    ``explode``) and into each place a later projection uses it. For long URL expressions, folds over nodes
    and Python calls that would repeat the work, so they are tied to the partition id. An array lookup rather
    than a condition does it, because common parts are shared only outside of conditions.
    """
    return F.get(F.array(value), F.least(F.spark_partition_id(), F.lit(0)))


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides, as str.strip() does."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def unify_lines(text: Column) -> Column:
    """Every line end becomes a newline; most texts have no other and pass one scan."""
    return F.when(text.rlike(LINE_END), F.regexp_replace(text, rf"\r\n|{LINE_END}", "\n")).otherwise(text)


def lines(text: Column) -> Column:
    """Lines as str.splitlines() gives them: no empty line after a final line end."""
    unified = F.regexp_replace(unify_lines(text), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(unified, "\n", -1))


def cjk_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))


def approx_tokens(text: Column) -> Column:
    """One token per CJK code point, one per four other code points, rounded up."""
    cjk = cjk_count(text)
    return (cjk + F.floor((F.length(text) - cjk + 3) / 4)).cast("int")


def overlap_tail(text: Column, units: int) -> Column:
    """The last ``units`` overlap units of ``text``, newlines dropped."""
    if units <= 0:
        return F.lit("")
    found = F.regexp_extract_all(text, F.lit(f"({TAIL_UNIT})"), F.lit(1))
    start = F.greatest(F.size(found) - units, F.lit(0)) + 1
    return F.array_join(F.slice(found, start, units), "")


@F.arrow_udf(T.StringType())
def _unescape(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else html.unescape(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _unescape_list(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else [html.unescape(s) for s in v] for v in values.to_pylist()],
                    pa.list_(pa.string()))


def decode_entities(text: Column) -> Column:
    """HTML entities to characters; only values that hold an ``&`` reach Python."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def decode_entity_list(values: Column) -> Column:
    """As :func:`decode_entities`, for an array of strings."""
    return F.coalesce(_unescape_list(F.when(F.array_join(values, "\n").contains("&"), values)), values)


def glob_regex(patterns: list[str]) -> str | None:
    """Shell globs as one anchored Java regex; ``*`` and ``?`` also match ``/`` and newlines."""
    return "(?s)\\A(?:" + "|".join(map(_glob, patterns)) + ")\\z" if patterns else None


def _glob(pattern: str) -> str:
    def piece(match: re.Match) -> str:
        star, mark, cls, char = match.groups()
        if star:
            return ".*"
        if mark:
            return "."
        if cls:
            negate, body = cls[1] == "!", cls[2:-1] if cls[1] == "!" else cls[1:-1]
            safe = re.sub(r"([\\\[\]^&~|])", r"\\\1", body)
            return f"[{'^' if negate else ''}{safe}]"
        return re.escape(char)

    return re.sub(r"(\*+)|(\?)|(\[!?\]?[^\]]*\])|(.)", piece, pattern, flags=re.S)
