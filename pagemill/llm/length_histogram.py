"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import prefix_sum

# Where the public tokenizers lie on the driver; tasks get the vocabulary with their function.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoded_lengths(docs: DataFrame, ranks: dict[bytes, int], keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``n_tokens``: tokens of the whole text; a null or empty text has none."""
    schema = docs.select(*keep).withColumn("n_tokens", F.lit(0).cast("bigint")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lengths, pa.int64())],
                                             names=[*batch.schema.names[:-1], "n_tokens"])

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(count, schema)


def _with_suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds ``docs_longer`` and ``tokens_longer``: sums over strictly longer documents, as prefix sums from the longest down."""
    down = counts.withColumn("_down", -F.col("n_tokens"))
    return prefix_sum(down, [], ["_down"], ["docs", "tokens"], ["docs_longer", "tokens_longer"]).select(
        "n_tokens", "docs", "tokens", "docs_longer", "tokens_longer")


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: ``n_tokens, docs, tokens, docs_longer, tokens_longer``.

    Suffix sums cover strictly longer documents. Lengths are dealt to ranges, and one total per range carries the sums
    on, so no task meets all lengths.
    """
    counts = (lengths.filter(F.col(length).isNotNull()).groupBy(F.col(length).cast("bigint").alias("n_tokens"))
              .agg(F.count("*").alias("docs")).withColumn("tokens", F.col("n_tokens") * F.col("docs")))
    return _with_suffix_sums(counts)


def at_limits(histogram: DataFrame, limits: DataFrame, limit: str = "n_tokens") -> DataFrame:
    """The histogram's rows for any ``limits``, whether a document has that length or not; answers follow from them.

    A limit no document has is a length of no documents, so it takes part in the same sums. Null limits have no
    answer, repeated ones have one.
    """
    asked = limits.select(F.col(limit).cast("bigint").alias("n_tokens")).filter("n_tokens is not null").distinct()
    zero = asked.select("n_tokens", F.lit(0).cast("bigint").alias("docs"), F.lit(0).cast("bigint").alias("tokens"), F.lit(1).alias("_asked"))
    rows = histogram.select("n_tokens", "docs", "tokens", F.lit(0).alias("_asked")).unionByName(zero)
    counts = rows.groupBy("n_tokens").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.max("_asked").alias("_asked"))
    down = prefix_sum(counts.withColumn("_down", -F.col("n_tokens")), [], ["_down"], ["docs", "tokens"],
                      ["docs_longer", "tokens_longer"])
    return down.filter("_asked = 1").select("n_tokens", "docs", "tokens", "docs_longer", "tokens_longer")


def context_answers(histogram: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Adds, for every length as context limit: ``total_tokens`` of all documents, ``truncated_tokens`` (each
    document cut at the limit), ``lost_tokens``, and ``quantile`` (share of documents that fit whole).

    ``of`` is the histogram that totals are taken of, where ``histogram`` holds only some limits of it.
    """
    of = histogram if of is None else of
    docs, total = (of.agg(F.sum(c).cast("bigint")).scalar() for c in ("docs", "tokens"))
    kept = F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")
    return (histogram.withColumns({"_docs": docs, "total_tokens": total})
            .select("n_tokens", "docs", "tokens", "docs_longer", "tokens_longer", "total_tokens",
                    kept.alias("truncated_tokens"), (F.col("total_tokens") - kept).alias("lost_tokens"),
                    ((F.col("_docs") - F.col("docs_longer")) / F.col("_docs")).alias("quantile")))


def length_at(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length at which at least ``share`` of the documents fit whole, as one row ``n_tokens``."""
    return context_answers(histogram).filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Histogram with answers for whole ``docs``.

    Null and empty texts count as documents of length 0. Repeated rows count as often as they occur. An empty
    table gives an empty histogram. Further columns are ignored.
    """
    lengths = encoded_lengths(docs.select("text"), load_ranks(f"{tokenizers}/{VOCABULARY}"), [])
    return context_answers(written(length_histogram(lengths), "histogram"))
