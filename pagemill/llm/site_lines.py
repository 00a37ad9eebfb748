"""Line dedup by site-relative frequency: lines on a large share of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import text_of

# A line is boilerplate when it is on more than this share of its host's pages ...
RATIO = 0.06
# ... and repeats at all.
MIN_PAGES = 2


def line_hash(line: Column) -> Column:
    """Two independent 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c")) == ""


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                      min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host, h, g, pages, host_pages)`` of every line over the ratio; lines without visible characters are none.

    A page counts once per line. Counts are partial sums before the shuffle, so a line on all pages of a hot
    host is one row per task. A null host is a host of its own.
    """
    lines = F.array_distinct(F.filter(F.split(text_of(text), "\n", -1), lambda line: ~is_blank(line)))
    rows = docs.select(F.col(host).alias("_host"), F.explode(F.transform(lines, line_hash)).alias("_line"))
    counts = (rows.groupBy("_host", F.col("_line.h").alias("h"), F.col("_line.g").alias("g"))
              .agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages))
    totals = docs.groupBy(F.col(host).alias("_h")).agg(F.count("*").alias("host_pages"))
    return (counts.join(small_side(totals, "host_pages"), F.col("_host").eqNullSafe(F.col("_h")))
            .filter(F.col("pages") > F.lit(ratio) * F.col("host_pages"))
            .select(F.col("_host").alias("host"), "h", "g", "pages", "host_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``docs`` with boilerplate lines taken out of the text, and ``_lines``, ``_dropped``.

    A host has at most (lines per page / ratio) boilerplate lines, which travel as one array per host, joined
    to its pages; texts are not shuffled unless the hosts are too many for a checked broadcast. Rows are never
    dropped: a page of boilerplate only keeps an empty text. A null text stays null with no lines; an empty text
    has one empty line, which is never boilerplate. Repeated rows are pages of their own.
    """
    bad = boilerplate_lines(docs, host, text, ratio, min_pages)
    bad = bad.groupBy(F.col("host").alias("_h")).agg(F.collect_list(F.struct("h", "g")).alias("_bad"))
    bad = small_side(bad, "boilerplate")
    split = F.split(F.col(text).cast("string"), "\n", -1)
    joined = docs.join(bad, F.col(host).eqNullSafe(F.col("_h")), "left")
    kept = F.when(F.col("_bad").isNull(), split).otherwise(
        F.filter(split, lambda line: is_blank(line) | ~F.array_contains(F.col("_bad"), line_hash(line))))
    n_lines, n_kept = F.size(split), F.size(F.col("_kept"))
    return (joined.withColumn("_kept", kept)
            .withColumn("_lines", F.when(F.col(text).isNull(), 0).otherwise(n_lines))
            .withColumn("_dropped", F.when(F.col(text).isNull(), 0).otherwise(n_lines - n_kept))
            .withColumn(text, F.array_join("_kept", "\n"))
            .drop("_h", "_bad", "_kept"))
