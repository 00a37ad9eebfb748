"""Optional streaming form of the cache upsert: a stream of fetched resources merged batch by batch.

A version holds the buckets of URLs that its batch touched; the cache is the newest complete copy of every bucket.
Copies that newer ones have replaced are removed after a time of grace, so the files follow the cache and not the batches.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import RESOURCES
from ..session import written
from ..sources.resources import upsert

# Buckets of URLs of a cache; a batch rewrites those it touches.
BUCKETS = 64
# Seconds that a replaced copy stays for those who are still reading it.
GRACE = 24 * 3600.0


def _files(spark: SparkSession, pattern: str) -> dict[str, float]:
    """Paths that match, with the time of their last change in seconds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return {s.getPath().toString(): s.getModificationTime() / 1000 for s in found or []}


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    return list(_files(spark, pattern))


def _remove(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _number(path: str, name: str) -> int:
    return int(path.rpartition(f"{name}=")[2].partition("/")[0])


def _versions(spark: SparkSession, root: str) -> set[int]:
    """Complete versions only: those whose write left its mark."""
    return {_number(p, "version") for p in _paths(spark, f"{root}/version=*/_SUCCESS")}


def latest_version(spark: SparkSession, root: str) -> int | None:
    return max(_versions(spark, root), default=None)


def read_cache(spark: SparkSession, root: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """The newest complete copy of every bucket, or of ``buckets``, in versions ``before`` one; empty before the first batch."""
    complete, newest = _versions(spark, root), {}
    for path in _paths(spark, f"{root}/version=*/bucket=*"):
        version, bucket = _number(path, "version"), _number(path, "bucket")
        if version in complete and (before is None or version < before) and (buckets is None or bucket in buckets):
            newest[bucket] = max(newest.get(bucket, (version, path)), (version, path))
    if not newest:
        return spark.createDataFrame([], RESOURCES)
    return spark.read.schema(RESOURCES).parquet(*(path for _, path in newest.values()))


def replaced_copies(spark: SparkSession, root: str, grace: float = GRACE, now: float | None = None) -> list[str]:
    """Bucket copies that nobody needs any more: a newer copy has been complete for ``grace`` seconds.

    The newest version may be written once more after a restart, from the copies before it. So it replaces none: every
    bucket keeps its newest copy and the newest one before the last version.
    """
    now = time.time() if now is None else now
    since = {_number(p, "version"): at for p, at in _files(spark, f"{root}/version=*/_SUCCESS").items()}
    copies: dict[int, list[tuple[int, str]]] = {}
    for path in _paths(spark, f"{root}/version=*/bucket=*"):
        version = _number(path, "version")
        if version in since and version < max(since):
            copies.setdefault(_number(path, "bucket"), []).append((version, path))
    return [path for held in copies.values() for (_, path), (newer, _) in zip(sorted(held), sorted(held)[1:])
            if now - since[newer] >= grace]


def compact(spark: SparkSession, root: str, grace: float = GRACE, now: float | None = None) -> int:
    """Remove the :func:`replaced_copies` and versions that hold no other; the number of copies removed.

    Only names are looked at, and the copies left are at most two per bucket and those still in their time of grace. A run
    cut short is made up for by the next one.
    """
    removed = replaced_copies(spark, root, grace, now)
    for path in removed:
        _remove(spark, path)
    versions = _versions(spark, root)
    held = {_number(p, "version") for p in _paths(spark, f"{root}/version=*/bucket=*")}
    for version in versions - held - {max(versions, default=0)}:
        _remove(spark, f"{root}/version={version}")
    return len(removed)


def merge_batch(root: str, first: int = 0, grace: float = GRACE):
    """``foreachBatch`` function: batch n writes the touched buckets of version ``first + n``. A repeated batch rewrites
    its own version from the ones before it, so a restart gives the same cache; late rows lose by ``fetched_at``.
    Copies replaced ``grace`` seconds ago are removed."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, first + batch_id
        bucket = F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int")
        batch = written(batch.filter(F.col("status") == 200), "batch")
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most BUCKETS numbers
        merged = upsert(read_cache(spark, root, version, touched), batch).withColumn("bucket", bucket)
        (merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/version={version}"))
        compact(spark, root, grace)
    return merge


def _first_version(spark: SparkSession, root: str, checkpoint: str) -> int:
    """The version of batch 0, kept beside the checkpoint's own files: a new checkpoint goes on after what ``root`` holds."""
    kept = f"{checkpoint}/first_version"
    if not _paths(spark, f"{kept}/_SUCCESS"):
        latest = latest_version(spark, root)
        first = 0 if latest is None else latest + 1
        spark.range(first, first + 1).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept).head()[0]


def stream_upsert(spark: SparkSession, incoming: str, root: str, checkpoint: str, grace: float = GRACE) -> StreamingQuery:
    """Consumes all resource files waiting in ``incoming`` and stops; ``grace`` as for :func:`merge_batch`."""
    stream = spark.readStream.schema(RESOURCES).option("maxFilesPerTrigger", 64).parquet(incoming)
    return (stream.writeStream.foreachBatch(merge_batch(root, _first_version(spark, root, checkpoint), grace))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
