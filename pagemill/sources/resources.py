"""Stored resources: one row per fetched URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESOURCES
from ..session import small_side


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESOURCES).parquet(path)


def save_resources(resources: DataFrame, name: str, path: str, buckets: int) -> None:
    """Store resources as an external table bucketed by URL: joins on URL then move only the other side."""
    (resources.write.mode("overwrite").bucketBy(buckets, "url").sortBy("url").option("path", path)
     .saveAsTable(name))


def usable(resources: DataFrame) -> DataFrame:
    """Rows a lookup may answer with: a body is there."""
    return resources.filter(F.length("html") > 0)


def scan_pages(urls: DataFrame, resources: DataFrame, fresh: bool = False) -> DataFrame:
    """Stored page of every URL; URLs without a hit, or all when ``fresh``, have a null status."""
    if fresh:
        return urls.withColumn("status", F.lit(None).cast("int")).withColumn("html", F.lit(None).cast("string"))
    return urls.join(usable(resources).select("url", "status", "html"), "url", "left")


def _moment(column: str = "fetched_at") -> Column:
    """A fetch time to compare by; no time is before any time."""
    return F.coalesce(column, F.lit(float("-inf")))


def newest(resources: DataFrame) -> DataFrame:
    """``(url, at, tied)`` of the newest good fetch of every URL; ``tied`` if several rows share its time."""
    at = (resources.filter(F.col("status") == 200).select("url", _moment().alias("at"))
          .groupBy("url", "at").agg(F.count("*").alias("_n")))
    return at.groupBy("url").agg(F.max("at").alias("at"), (F.max_by("_n", "at") > 1).alias("tied"))


def upsert(cache: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cache after storing ``incoming``: only status 200 is stored, the newest fetch of a URL wins.

    Winners are chosen on URLs and times alone; bodies are then taken from either side by a semi and an anti
    join on them, broadcast when they are few. On a tie of ``fetched_at`` the incoming row wins, and among
    incoming rows the greater body: only such rows have their bodies aggregated.
    """
    columns = ["url", "status", "html", "fetched_at"]
    stored = cache.select("url", _moment().alias("_stored"))
    came = newest(incoming)
    later = came.join(stored, "url").filter(F.col("_stored") > F.col("at")).select("url")
    winners = small_side(came.join(later, "url", "left_anti"), "winners")
    rows = incoming.filter(F.col("status") == 200).select(*columns).withColumn("at", _moment())
    fresh = rows.join(winners.filter("not tied").select("url", "at"), ["url", "at"], "left_semi")
    tied = rows.join(winners.filter("tied").select("url", "at"), ["url", "at"], "left_semi")
    tied = tied.groupBy("url").agg(F.first("status").alias("status"), F.max("html").alias("html"),
                                   F.first("fetched_at").alias("fetched_at"))
    kept = cache.join(winners.select("url"), "url", "left_anti").select(*columns)
    return kept.unionByName(fresh.select(*columns)).unionByName(tied.select(*columns))
