"""Order inside a site without pulling the site into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, written

# Up to this rank every map task trims its rows per group before the shuffle; beyond it rows are ranked.
_PARTIAL_TOP_N = 1000
_SALTS = 64


def rank_in_group(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Exact 1-based position of each row in its group, as column ``name``.

    Rows are range-partitioned and sorted by (group, order), so a hot group spreads over many tasks.
    ``monotonically_increasing_id`` numbers rows inside a partition; the start of a group in each
    partition comes from one small count per (group, partition). ``order`` must be unique per group.
    """
    keys = [*group, *order]
    placed = written(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "placed")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
              .select(*group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    return (placed.join(small_side(starts, "starts"), [*group, "_part"])
            .withColumn(name, F.col("_at") + F.col("_shift") + 1)
            .drop("_at", "_part", "_shift"))


def top_n(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must be unique per group.

    Two rounds: first within salted parts of a group, then over at most 64 n survivors.
    """
    if n > _PARTIAL_TOP_N:
        return rank_in_group(df, group, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")

    def trimmed(rows: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
    return trimmed(trimmed(salted, [*group, "_salt"]), group).drop("_salt")
