"""Output tables and documents. Every writer spreads a large site over many files and lets small ones
share a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import last_writer
from ..schemas import CHUNKS, MANIFEST
from ..session import small_side


def with_text(pages: DataFrame) -> DataFrame:
    return pages.filter((F.col("error") == "") & (F.col("markdown") != ""))


def write_by_site(df: DataFrame, path: str, order: list[str], format: str = "json", mode: str = "overwrite") -> None:
    """Rows under ``site=…``, sorted inside each file.

    Rebalancing lets AQE split a large site and join small ones; unlike a range partitioning it does not
    compute the rows a second time to sample them.
    """
    (df.hint("rebalance", "site").sortWithinPartitions("site", *order)
     .write.mode(mode).partitionBy("site").format(format).save(path))


def write_corpus(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON lines under ``site=…``."""
    write_by_site(chunks, path, ["url", "seq"])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def markdown_files(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """``(site, path, content)``: each page with front matter; of colliding paths the last one stays."""
    title = F.replace("title", F.lit("\n"), F.lit(" "))
    title = F.replace(F.replace(title, F.lit(":"), F.lit(" -")), F.lit("---"), F.lit("—"))
    starts = sites.select("site", F.col("url").alias("source"))
    content = F.concat(F.lit("---\ntitle: "), title, F.lit("\nurl: "), F.col("url"), F.lit("\nsource: "),
                       F.col("source"), F.lit("\n---\n\n"), F.col("markdown"), F.lit("\n"))
    return (last_writer(with_text(pages)).join(starts, "site")
            .select("site", F.concat("path", F.lit(".md")).alias("path"), content.alias("content")))


def page_json(pages: DataFrame) -> DataFrame:
    """``(site, path, json)``: the structured form of each page; of colliding paths the last one stays."""
    return last_writer(with_text(pages)).select("site", F.concat("path", F.lit(".json")).alias("path"),
                                               _page_struct().alias("json"))


def _page_struct() -> Column:
    return F.to_json(F.struct("url", "path", "title", "toc", "meta", "markdown"), {"ignoreNullFields": "false"})


def _site_document(pages: DataFrame, body: Column, separator: str) -> DataFrame:
    """Body rows of a whole-site document; all but a site's first start with ``separator``."""
    pages = with_text(pages)
    first = small_side(pages.groupBy("site").agg(F.min("ord").alias("_first")), "first")
    lead = F.when(F.col("ord") == F.col("_first"), "").otherwise(separator)
    return pages.join(first, "site").select("site", F.lit(1).alias("part"), "ord", F.concat(lead, body).alias("text"))


def site_json(pages: DataFrame, sites: DataFrame, generated_at: str) -> DataFrame:
    """The whole-site JSON document as ordered rows ``(site, part, ord, text)``.

    Rows in (part, ord) order, each followed by a line end, are the document: a header, one row per page
    and a footer. A site is never gathered into one row.
    """
    head = F.to_json(F.struct("site", "url", "adapter", F.lit(generated_at).alias("generated_at")))
    head = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"pages":['))
    edges = sites.select("site", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), head.alias("text")),
        F.struct(F.lit(2).alias("part"), F.lit("]}").alias("text")))).alias("e"))
    edges = edges.select("site", "e.part", F.lit(0).cast("bigint").alias("ord"), "e.text")
    return edges.unionByName(_site_document(pages, _page_struct(), ","))


def site_markdown(pages: DataFrame) -> DataFrame:
    """The whole-site markdown document as ordered rows, pages parted by a rule."""
    body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\nSource: "), F.col("url"), F.lit("\n\n"), F.col("markdown"))
    return _site_document(pages, body, "\n---\n\n")


def write_site_documents(rows: DataFrame, path: str) -> None:
    """Writes document rows as text under ``site=…``; part files in name order give the document."""
    keys = ["site", "part", "ord"]
    (rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("site", "text")
     .write.mode("overwrite").partitionBy("site").text(path))


def write_manifest(manifests: DataFrame, urls: DataFrame, path: str) -> None:
    """Manifest headers under ``<path>/sites`` and their URL rows under ``<path>/urls``."""
    manifests.withColumn("site", F.col("name")).write.mode("overwrite").partitionBy("site").json(f"{path}/sites")
    write_by_site(urls, f"{path}/urls", ["list", "ord"])


def read_manifests(spark: SparkSession, glob: str) -> DataFrame:
    """Manifest headers sorted by file path; unreadable files are skipped."""
    raw = (spark.read.schema(MANIFEST + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").json(glob))
    some = F.coalesce("name", "url", "out_dir", "source").isNotNull()
    good = raw.select("*", F.col("_metadata.file_path").alias("file")).filter(F.col("_bad").isNull() & some)
    return good.drop("_bad").orderBy("file")
