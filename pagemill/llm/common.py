"""Helpers shared by the corpus operators: table access, words, salted prefix sums and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_side, written

# Fixed value: what parts words.
WORD_BREAK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, '' for a null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefix_sum(df: DataFrame, group: list[str], order: list[str], value: str | list[str], name: str | list[str]) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in its group, in ``order``; or several of each.

    Rows are range-partitioned by (group, order), so a hot group spreads over many tasks; one total per
    (group, partition) carries the sum across partitions. ``order`` must be unique per group.
    """
    values, names = ([x] if isinstance(x, str) else x for x in (value, name))
    keys = [*group, *order]
    placed = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "placed")
    totals = placed.groupBy(*group, "_part").agg(*(F.sum(v).alias(f"_sum{i}") for i, v in enumerate(values)))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_p"),
                           *(F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_start{i}") for i in range(len(values))))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"_inside{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(values)})
    return (summed.join(small_side(starts, "starts"), same, "left")
            .withColumns({n: F.col(f"_inside{i}") + F.col(f"_start{i}") for i, n in enumerate(names)})
            .drop("_part", "_p", *(f"_{kind}{i}" for kind in ("inside", "start") for i in range(len(values))),
                  *(f"_g{i}" for i in range(len(group)))))


def _is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every node of ``edges``: the smallest node reachable from it.

    Contraction: every node hooks on its smallest neighbour below it, hooks are followed to their ends by
    doubling, and edges are rewritten between the ends until none joins two of them. Every step is a partial
    minimum, a distinct or a join with the written map of hooks, so a hub never meets in one task; edges
    shrink with every round. The driver learns only whether a table is empty.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    edges = written(edges.filter(F.col(a) != F.col(b)).select(lo, hi).distinct(), "edges")
    result = edges.select(F.col("lo").alias("id")).union(edges.select("hi")).distinct().withColumn("component", F.col("id"))
    while not _is_empty(edges):
        hooks = written(edges.groupBy(F.col("hi").alias("from")).agg(F.min("lo").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("_next"))
            hooks = written(hooks.join(small_side(further, "further"), "to", "left")
                            .select("from", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")),
                            "hooks")
            moved = hooks.filter("moved")
            hooks = hooks.drop("moved")
            if _is_empty(moved):
                break
        hooks = small_side(hooks, "ends")

        def end_of(df: DataFrame, column: str) -> DataFrame:
            renamed = hooks.select(F.col("from").alias(column), F.col("to").alias("_end"))
            return df.join(renamed, column, "left").withColumn(column, F.coalesce("_end", column)).drop("_end")

        result = written(end_of(result, "component"), "components")
        moved_edges = end_of(end_of(edges, "lo"), "hi").filter("lo <> hi")
        edges = written(moved_edges.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct(),
                        "edges")
    return result


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable over the pairs, per node."""
    root = np.arange(size)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if np.array_equal(before, root):
            return root
