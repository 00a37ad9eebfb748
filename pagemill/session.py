"""Session settings, the shared scratch folder and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the jobs are tuned for; a value set by the user wins.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # HTML rows are large: small Arrow batches keep Python workers inside their memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

# A written table may be broadcast below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
# Bound for tables that every level of a walk broadcasts anew.
LEVEL_ROWS = 20_000
# So many times a core's fair share may lie in one scan partition.
SPREAD_SKEW = 2


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults that the user has not set."""
    own = spark.conf.getAll     # only what was set, not Spark's own defaults
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "pagemill", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``; a temp folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # one process; not a local cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/pagemill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` below the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """As :func:`written`, in buckets of ``key``, one file each: a join on it shuffles only the other side."""
    spark = df.sparkSession
    table, buckets = f"{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE {table}")


def join_side(table: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """A table of ``rows`` rows as a join side: broadcast up to ``max_rows``, else merged.

    Left alone, Spark would go by the size of the compressed files and broadcast many more rows.
    """
    return F.broadcast(table) if rows <= max_rows else table.hint("merge")


def small_side(df: DataFrame, name: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a join side, take its size from the files, and broadcast it only when it is small.

    Beyond ``max_rows`` or ``BROADCAST_BYTES`` the written table is to be merged, so that Spark shuffles and AQE
    splits skewed partitions.
    """
    table = written(df, name)
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return join_side(table, table.count() if size <= BROADCAST_BYTES else max_rows + 1, max_rows)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table whose rows lie on all cores; it is shuffled only when they do not.

    Scan partitions say little: a file of one row group is read by one of them, however many there are. So the rows
    of each are counted, from the footers alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    parts = table.rdd.getNumPartitions()
    if parts >= cores:
        counts = table.groupBy(F.spark_partition_id().alias("part")).count()
        largest, rows = counts.agg(F.max("count"), F.sum("count")).first()
        if (largest or 0) * cores <= SPREAD_SKEW * (rows or 0):
            return table
    # Dealt by a number, for a plain repartition would first sort whole rows to be repeatable.
    return (table.withColumn("_at", F.monotonically_increasing_id())
            .repartition(max(parts, cores), "_at").drop("_at"))
