"""Secret scan with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written
from .common import text_of

# The base patterns; a match that fails its length test is dropped after matching.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
)
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
# What runs: greedy runs that must reach a length are found directly, which leaves the same spans.
_SCAN = {"assign": BASE[0][1], "access": rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", "hex": rf"[0-9a-f]{{{HEX_LENGTH},}}"}

# Weak parts of a credential: told only where their complement is near.
WEAK = {
    "ident": r"""(?i:\b(?:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    "key": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"""(?i:\b(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://)[^\s"'<>]+""",
}
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "identifier", "ident": "identifier",
         "endpoint": "endpoint"}
# A part's complement must lie within this many code points of it: both are then in one scope.
SCOPE = 200

_FOLD = 256


def exclusive_sums(values: Column) -> Column:
    """Sum of the elements before each element of an int array: a fold per block, shifted by a fold of block sums."""
    def fold(items: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(items, zero, step, lambda acc: acc["out"])

    zero = F.lit(0).cast("int")
    count = F.ceil(F.size(values) / F.lit(_FOLD)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * _FOLD + 1, F.lit(_FOLD)))
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda s, v: s + v))
    return F.flatten(F.zip_with(blocks, fold(totals, zero), fold))


def spans(text: Column, found: Column, pattern: str, kind: str) -> Column:
    """``array<struct<start, kind, end>>`` in code points, from the matches and the text between them."""
    number = F.lit(KINDS.index(kind))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    between = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    lengths = F.transform(found, lambda m: F.length(m))
    # a match starts after all gaps up to its own and all matches before it
    starts = F.zip_with(exclusive_sums(F.slice(F.zip_with(between, lengths, lambda g, n: g + F.coalesce(n, F.lit(0))), 1, F.size(found))),
                        F.slice(between, 1, F.size(found)), lambda s, g: s + g)
    return F.when(F.size(found) > 0, F.zip_with(starts, lengths, lambda s, n: F.struct(
        s.alias("start"), number.alias("kind"), (s + n).alias("end")))).otherwise(empty)


def span_string(items: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(items), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def all_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a span array per kind, base ones as the contract has them, weak ones as candidates."""
    patterns = {**_SCAN, **WEAK}
    keep = docs.columns
    docs = docs.withColumn("_text", text_of(text))
    found = docs.select(*keep, "_text", F.regexp_extract_all("_text", F.lit(patterns["assign"]), F.lit(2)).alias("_values"),
                        *(F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_found_{k}") for k, p in patterns.items()))
    located = found.select(*keep, "_values", *(spans(F.col("_text"), F.col(f"_found_{k}"), p, k).alias(k) for k, p in patterns.items()))
    long_enough = F.filter(F.arrays_zip("assign", "_values"), lambda z: F.length(z["_values"]) >= ASSIGN_VALUE)
    return located.withColumn("assign", F.transform(long_enough, lambda z: z["assign"])).drop("_values")


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts whose complement is in scope, from ``(_row, start, kind, end, role, weak)``.

    An interval join: every part is put in the blocks of code points its scope touches, and meets the parts
    that begin in one of them. A block holds a bounded number of parts, so no row of the join grows with a document or a
    group. An identifier needs a secret, a secret an identifier, an endpoint both.
    """
    width = 2 * scope
    reach = F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / width), F.floor((F.col("end") + scope) / width))
    wide = parts.filter("weak").withColumn("_block", F.explode(reach))
    near = parts.select("_row", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("role").alias("_role"),
                        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_block"))
    met = wide.join(near, ["_row", "_block"]).filter(
        (F.col("role") != F.col("_role")) & (F.col("_s") <= F.col("end") + scope) & (F.col("start") <= F.col("_e") + scope))
    by_part = met.groupBy("_row", "start", "kind", "end", "role").agg(
        F.bool_or(F.col("_role") == "secret").alias("_secret"), F.bool_or(F.col("_role") == "identifier").alias("_identifier"))
    told = (F.when(F.col("role") == "identifier", F.col("_secret")).when(F.col("role") == "secret", F.col("_identifier"))
            .otherwise(F.col("_secret") & F.col("_identifier")))
    return by_part.filter(told).select("_row", F.struct("start", "kind", "end").alias("span"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``(key, base, linked)`` per row: base spans, and weak parts of credentials whose complement is near.

    Whole texts; a null text is an empty one and has no spans. Spans of one kind do not overlap; those of two
    kinds may. Weak spans inside a base span are left out. Repeated rows are scanned each; an empty table gives
    an empty result; other columns are ignored. Only spans are shuffled, never texts.
    """
    located = all_spans(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text_in")), "_text_in")
    base = F.concat("assign", "access", "hex")
    weak = F.filter(F.concat(*WEAK), lambda w: ~F.exists(F.col("base"), lambda b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])))
    rows = located.select("_key", F.monotonically_increasing_id().alias("_row"), base.alias("base"), *WEAK)
    rows = written(rows.withColumn("weak", weak).drop(*WEAK), "spans")
    roles = F.array(*(F.lit(ROLES[k]) for k in KINDS))
    parts = (rows.filter(F.size("weak") > 0)
             .select("_row", F.explode(F.concat("base", "weak")).alias("s"))
             .select("_row", "s.*", F.element_at(roles, F.col("s.kind") + 1).alias("role"), (F.col("s.kind") >= len(BASE)).alias("weak")))
    linked = linked_parts(parts, scope).groupBy("_row").agg(F.collect_list("span").alias("linked"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (rows.select("_key", "_row", "base").join(small_side(linked, "linked"), "_row", "left")
            .select(F.col("_key").alias(key), "base", F.coalesce("linked", none).alias("linked")))
