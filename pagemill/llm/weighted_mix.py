"""Mixing sources to target weights: water-filled targets and Efraimidis-Spirakis selection inside a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side, written
from .common import prefix_sum, text_of, word_count

# Sources in code-point order, null last, weigh these, repeating.
WEIGHTS = (1, 2, 3)
# No source, hence no document, is taken more often than this.
MAX_EPOCHS = 3
SEED = 20


def quality_weight(text: Column) -> Column:
    """A weight in [0.1, 1]: the share of letters and blanks in a text, so symbol soup is drawn later."""
    noise = F.length(F.regexp_replace(text, r"[\p{L}\x20\n.,]+", ""))
    return F.greatest(F.lit(0.1), 1 - noise / F.greatest(F.length(text), F.lit(1)))


def exponential_key(key: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from the key: the smallest keys are a weighted sample without replacement."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11)
    return -F.log((bits + 0.5) / float(1 << 53)) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: shares of the total by weight.

    A target stops at ``max_epochs`` times its source's size, and the excess is shared again by weight among
    the others until none is above. Sources reach their caps in order of cap / weight; with those before a source at
    their caps, the others share the rest at one level per weight. Sharing ends at the first level that does not exceed
    its own source's cap; later ones are no higher. So prefix sums in that order give all levels at once, and the one
    sought is the greatest of those.
    """
    rows = sizes.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    rows = prefix_sum(rows.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), ["_all"], ["_null", "_name"], "_one", "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_epochs
    rows = rows.withColumn("_weight", weight).withColumn("_cap", cap).withColumn("_full", cap / weight)
    rows = written(prefix_sum(rows, ["_all"], ["_full", "_rank"], ["_cap", "_weight"], ["_capped", "_lighter"]), "sources")
    total, weighed = rows.agg(F.sum("source_size"), F.sum("_weight")).head()
    level = (F.lit(total or 0) - F.col("_capped")) / (F.lit(weighed or 0) - F.col("_lighter"))
    ends = rows.agg(F.max(F.when(level <= F.col("_full"), level))).head()[0]
    target = F.col("_cap") if ends is None else F.least(F.lit(ends) * F.col("_weight"), F.col("_cap").cast("double"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED,
                weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, row: str | None = None) -> DataFrame:
    """``(_row, key, source, size, source_size, target, taken)``: one row per document.

    ``size`` counts words, 0 for a null or empty text. A source's target holds so many complete epochs of all
    its documents; the rest goes to documents by exponential keys divided by quality weight, prefix-summed in key order up to the
    budget. The last document of the selection is taken in part, so that a source's words meet its rounded target.
    Ties of keys are parted by the key column, the text and a number of the row, so repeated rows are documents
    of their own. ``row`` may name a column that numbers the rows, to tell repeated ones apart in what is returned. Empty
    tables give an empty result; other columns are ignored.
    """
    body = text_of(text)
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(body).alias("size"),
                       exponential_key(F.struct(F.col(key), body), quality_weight(body), seed).alias("_draw"),
                       F.xxhash64(body).alias("_tie"),
                       (F.col(row) if row else F.monotonically_increasing_id()).alias("_row"))
    rows = written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    targets = small_side(source_targets(sizes, weights, max_epochs).withColumnRenamed("source", "_source"), "targets")
    summed = prefix_sum(rows, ["source"], ["_draw", "_key", "_tie", "_row"], "size", "_before")
    summed = summed.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    goal = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = goal - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return summed.select("_row", F.col("_key").alias(key), "source", "size", "source_size", "target",
                         (epochs * F.col("size") + part).cast("bigint").alias("taken"))
