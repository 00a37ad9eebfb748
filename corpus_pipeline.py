"""A training corpus from documents: classified, stripped of boilerplate, deduplicated, mixed and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import bayes_dedup, lattice_sampling, site_lines, subword_classifier, weighted_mix
from pagemill.llm.common import table
from pagemill.session import small_side, tune, written

# A stage with training or scoring cannot be put in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts (score 0.5 or more), judged row by row.

    A null or empty text has the score of a text without words; a null id takes no part in fitting; equal rows share a fate.
    """
    tune(spark)
    model = subword_classifier.train(subword_classifier.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = subword_classifier.score_documents(docs, model, name="_score")
    return scored.filter(F.col("_score") >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines; ``n_chars`` follows the text.

    No row goes: a text of boilerplate only is left empty, a null text stays null. Repeated rows are pages of their own.
    """
    tune(spark)
    cleaned = site_lines.drop_boilerplate(docs)
    n_chars = F.when(F.col("_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, ``_number``, written, so that it is the same wherever it is read."""
    return written(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, then the first by text.

    Rows are compared as such: two rows of one id with unlike texts both stay, equal rows are copies of each other. Null
    ids come last in the choice. Null and empty texts have no copies and stay.
    """
    tune(spark)
    rows = _numbered(docs)
    found = written(bayes_dedup.near_duplicates(rows, key="_number").filter("component_id is not null"), "near")
    grouped = found.groupBy("component_id").count().filter("count > 1").select("component_id")
    copies = found.join(small_side(grouped, "groups"), "component_id").select("_number", "component_id")
    choice = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_number")
    ranked = rows.select("_number", choice.alias("_choice")).join(small_side(copies, "members"), "_number")
    best = ranked.groupBy("component_id").agg(F.min("_choice").alias("_best"))
    gone = (ranked.join(small_side(best, "best"), "component_id").filter(F.col("_choice._number") != F.col("_best._number"))
            .select("_number"))
    return rows.join(small_side(gone, "copies"), "_number", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whole: of the one taken in part at least half must be wanted.

    Rows are counted one by one, also those that repeat an id or have none. A text without words is never taken.
    """
    tune(spark)
    rows = _numbered(docs)
    taken = weighted_mix.mix_sources(rows, row="_number")
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    wanted = taken.select(F.col("_row").alias("_number"), copies.alias("_copies")).filter("_copies > 0")
    mixed = rows.join(small_side(wanted, "wanted"), "_number")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row, as piece ids; a null or empty text has the empty one."""
    tune(spark)
    vocabulary = lattice_sampling.load_vocabulary(f"{lattice_sampling.TOKENIZERS}/{lattice_sampling.MODEL}")
    return lattice_sampling.encode_samples(docs, vocabulary).select("doc_id", "sample", "ids", "log_prob", "inclusion")


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("mix", mix),
          ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, f"stage{number}") if number < len(STAGES) - 1 else docs
    return docs
