"""Markdown to heading-aware, token-bounded, overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import MAX_TOKENS, OVERLAP, chunks_of, part_chunks, part_starts
from ..functions.text import SPACE, approx_tokens, once, overlap_tail, strip, unify_lines
from ..session import small_side, written

# Characters from which a text is packed in parts.
PART_CHARS = 1_000_000

_BLANK = rf"[{SPACE}&&[^\n]]"


def split_blocks(markdown: Column) -> Column:
    """``array<struct<heading_path, text>>``: one block per heading line, and one for text before the first.

    The text is split at level 1, the parts at level 2, and so on: a part inherits the path of the part
    it was cut from, which is the path a stack of open headings would give. Code fences are not special.
    """
    none = F.array().cast("array<string>")
    whole = F.array(F.struct(none.alias("heading_path"), unify_lines(markdown).alias("text")))
    parts = F.when(markdown != "", whole).otherwise(F.array().cast("array<struct<heading_path:array<string>,text:string>>"))
    for level in range(1, 7):
        parts = F.flatten(F.transform(parts, _level_splitter(level)))
    return F.transform(parts, lambda p: F.struct(p["heading_path"].alias("heading_path"), strip(p["text"]).alias("text")))


def _level_splitter(level: int):
    mark = "#" * level

    def split(part: Column) -> Column:
        def labelled(text: Column) -> Column:
            title = strip(F.regexp_extract(text, rf"\A{mark}{_BLANK}+([^\n]*)", 1))
            path = F.when(text.rlike(rf"\A{mark}{_BLANK}"), F.concat(part["heading_path"], F.array(title)))
            return F.struct(path.otherwise(part["heading_path"]).alias("heading_path"), text.alias("text"))

        pieces = F.transform(F.split(part["text"], rf"\n(?={mark}{_BLANK})", -1), labelled)
        return F.when(part["text"].contains(mark), pieces).otherwise(F.array(part))

    return split


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """One row per chunk: all columns but ``markdown``, then ``seq`` from 0, ``heading_path, tokens, text``."""
    keep = [c for c in docs.columns if c != "markdown"]
    return (docs.filter(F.col("markdown") != "").withColumn("_blocks", once(split_blocks(F.col("markdown"))))
            .withColumn("_chunks", once(chunks_of(F.col("_blocks"), max_tokens, overlap)))
            .select(*keep, F.posexplode("_chunks").alias("seq", "c"))
            .select(*keep, "seq", "c.heading_path", "c.tokens", "c.text"))


def chunk_parts(docs: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP,
                part_chars: int = PART_CHARS) -> DataFrame:
    """As :func:`chunk_documents`, but every text is cut into parts that are packed in tasks of their own.

    A part takes whole blocks until it holds ``part_chars`` characters. Its last chunk ends with it, and the first chunk of
    the next part starts with the last ``overlap`` units of the text before, as any chunk does that follows a full one.
    Headings above a part keep naming its blocks. Only a single block larger than a part stays with one task. Null and
    empty texts give no rows.
    """
    keep = [c for c in docs.columns if c != "markdown"]
    blocks, starts = F.col("_blocks"), F.col("_starts")

    def part(start: Column, no: Column) -> Column:
        before = F.coalesce(F.get(starts, no - 1), F.lit(0))
        earlier = F.slice(blocks, before + 1, start - before)
        tail = overlap_tail(F.array_join(F.transform(earlier, lambda b: b["text"]), "\n\n"), overlap)
        last = F.get(blocks, start - 1)["text"]
        return F.struct(
            no.alias("part"), F.slice(blocks, start + 1, F.coalesce(F.get(starts, no + 1), F.size(blocks)) - start).alias("blocks"),
            F.when(no > 0, tail).alias("tail"), F.coalesce(approx_tokens(last) <= max_tokens, F.lit(False)).alias("follows"))

    cut = (docs.filter(F.col("markdown") != "").withColumn("_blocks", once(split_blocks(F.col("markdown"))))
           .withColumn("_starts", once(part_starts(F.transform(blocks, lambda b: F.length(b["text"])), part_chars)))
           .withColumn("_doc", F.monotonically_increasing_id()).select(*keep, "_doc", F.explode(F.transform(starts, part)).alias("p"))
           .select(*keep, "_doc", "p.*"))
    # A fixed number of partitions, for a coalesced shuffle would put the parts of one text back together.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = part_chunks(F.col("blocks"), F.col("tail"), F.col("follows"), max_tokens, overlap)
    packed = written(cut.repartition(tasks, "_doc", "part").select(*keep, "_doc", "part", chunks.alias("_chunks")), "parts")
    earlier = Window.partitionBy("_doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(packed.select("_doc", "part", F.coalesce(F.sum(F.size("_chunks")).over(earlier), F.lit(0)).cast("int")
                                       .alias("_offset")), "offsets")
    return (packed.join(offsets, ["_doc", "part"]).select(*keep, "_offset", F.posexplode("_chunks").alias("_no", "c"))
            .select(*keep, (F.col("_offset") + F.col("_no")).alias("seq"), "c.heading_path", "c.tokens", "c.text"))


def corpus_rows(pages: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, part_chars: int = PART_CHARS) -> DataFrame:
    """Corpus records of the pages that made it and have text; texts over ``part_chars`` are packed in parts.

    ``pages`` is scanned once for either kind, so it should be a written table.
    """
    good = pages.filter(F.col("error") == "").select("site", "url", "path", "title", "markdown")
    large = written(good.filter(F.length("markdown") > part_chars), "large")
    rows = chunk_documents(good.filter(F.length("markdown") <= part_chars), max_tokens, overlap)
    return rows if large.isEmpty() else rows.unionByName(chunk_parts(large, max_tokens, overlap, part_chars))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens per site."""
    return chunks.groupBy("site").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
