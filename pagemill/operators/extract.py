"""Main content of HTML pages as markdown, a table of contents and metadata.

A page becomes one row with an array of content nodes; everything after that is expressions over the
array, so extraction needs no shuffle and HTML never leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html_nodes import html_nodes, selected_nodes
from ..functions.pages import clean_title, page_meta, page_title
from ..functions.platforms import selectors_of
from ..functions.text import SPACE, once, strip

# Fixed value: anchor signs that documentation tools append to headings.
_ANCHOR_SIGNS = rf"[\x{{b6}}\x{{a7}}\x{{200b}}]+[{SPACE}]*\z"
# Raw text of a selector counts from so many characters on.
MIN_RAW_TEXT = 50
# Signs a block's score counts at most, and the score from which an unsure block is text.
BLOCK_SCORE = 25
TEXT_SCORE = 16


def root_nodes(nodes: Column) -> Column:
    """Nodes inside main/article when the page has such an element, else all nodes outside noise."""
    return F.when(F.exists(nodes, lambda n: n["in_root"]), F.filter(nodes, lambda n: n["in_root"])).otherwise(nodes)


def signs(node: Column) -> Column:
    return F.length(F.regexp_replace(node["text"], f"[{SPACE}]", ""))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled_nodes(nodes: Column) -> Column:
    """Drops the navigation among ``unsure`` nodes, those behind the start tag of noise without an end tag.

    A block scores its signs outside links less those inside, at most ``BLOCK_SCORE`` either way. One with more text than
    links stays when twice its score and the scores of two neighbours on either side exceed ``TEXT_SCORE`` (a heading
    goes with what follows it). However short, it also stays when no links stand in the two blocks behind it and its run
    of unsure text blocks holds one that stays by its score, or a heading with text behind it. A block of links stays only
    when it stands between two blocks of text.
    """
    def score(node: Column) -> Column:
        net = F.greatest(F.lit(-BLOCK_SCORE), F.least(F.lit(BLOCK_SCORE), signs(node) - 2 * node["linked"]))
        return F.when(node["kind"] == "code", BLOCK_SCORE).otherwise(net)

    def settle(scores: Column) -> Column:
        def at(i: Column) -> Column:
            return F.coalesce(F.get(scores, i), F.lit(0))

        def text(node: Column, i: Column) -> Column:
            before = F.when(node["kind"] == "heading", F.lit(0)).otherwise(at(i - 2) + at(i - 1))
            return (at(i) > 0) & (2 * at(i) + before + at(i + 1) + at(i + 2) > TEXT_SCORE)

        def kept(texts: Column, runs: Column) -> Column:
            def stays(node: Column, i: Column) -> Column:
                short = F.get(runs, i) & (F.least(at(i + 1), at(i + 2)) >= 0)
                return ~node["unsure"] | F.when(at(i) > 0, F.get(texts, i) | short).otherwise(
                    F.least(at(i - 1), at(i + 1)) > TEXT_SCORE)
            return F.filter(nodes, stays)

        ends = F.filter(F.transform(nodes, lambda n, i: F.when((at(i) <= 0) | ~n["unsure"], i)), lambda i: i.isNotNull())
        ends = F.concat(F.array(F.lit(-1)), ends, F.array(F.size(nodes)))
        return _let(F.transform(nodes, text), lambda texts: _let(ends, lambda ends: _let(
            _runs(nodes, texts, ends), lambda runs: kept(texts, runs))))

    # The scores are an array of their own, computed once per page and only where a node is unsure.
    return F.when(F.exists(nodes, lambda n: n["unsure"]), _let(F.transform(nodes, score), settle)).otherwise(nodes)


def _runs(nodes: Column, texts: Column, ends: Column) -> Column:
    """For every node, whether the run it stands in is text; ``ends`` are the positions between which the runs lie."""
    def spread(start: Column, no: Column) -> Column:
        length = F.get(ends, no + 1) - start
        headed = F.exists(F.slice(nodes, start + 2, F.greatest(length - 2, F.lit(0))), lambda n: n["kind"] == "heading")
        return F.array_repeat(headed | F.exists(F.slice(texts, start + 2, length - 1), lambda text: text), length)

    return F.flatten(F.transform(F.slice(ends, 1, F.size(ends) - 1), spread))


def has_prose(nodes: Column) -> Column:
    """False for pages of nothing but headings and links: those go to the selector fallback."""
    return F.exists(nodes, lambda n: ~n["kind"].isin("heading", "error") & (
        signs(n) > n["linked"]))


def heading_title(node: Column) -> Column:
    return strip(F.regexp_replace(node["text"], _ANCHOR_SIGNS, ""))


def toc_of(nodes: Column) -> Column:
    """``{level, title, anchor}`` of every heading in document order; anchors stay empty."""
    return F.transform(F.filter(nodes, lambda n: n["kind"] == "heading"), lambda n: F.struct(
        n["level"].alias("level"), heading_title(n).alias("title"), F.lit("").alias("anchor")))


def table_markdown(rows: Column) -> Column:
    """Pipe table: rows padded to the widest, pipes escaped, a rule after the first row."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    def line(row: Column) -> Column:
        cells = F.transform(row, lambda c: F.replace(
            strip(F.regexp_replace(c, f"[{SPACE}]*\n[{SPACE}]*", " ")), F.lit("|"), F.lit("\\|")))
        padded = F.concat(cells, F.array_repeat(F.lit(""), width - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    drawn = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, 2, F.greatest(F.size(drawn) - 1, F.lit(0)))), "\n")


def list_item(node: Column) -> Column:
    mark = F.when(node["ordinal"] > 0, F.concat(node["ordinal"].cast("string"), F.lit(". "))).otherwise("- ")
    return F.concat(F.repeat(F.lit("  "), node["level"]), mark, node["text"])


def block_markdown(node: Column, following: Column) -> Column:
    """Markdown of one node with its trailing blank line; list items stay together."""
    kind, text = node["kind"], node["text"]
    code = F.regexp_replace(text, r"\A\n+|\n+\z", "")
    together = (kind == "item") & F.coalesce(following["list_no"] == node["list_no"], F.lit(False))
    body = (F.when(kind == "heading", F.concat(F.lit("\n"), F.repeat(F.lit("#"), node["level"]), F.lit(" "),
                                               heading_title(node), F.lit("\n")))
            .when(kind == "code", F.concat(F.lit("```\n"), code, F.lit("\n```")))
            .when(kind == "quote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
            .when(kind == "item", list_item(node))
            .when(kind == "table", table_markdown(node["rows"]))
            .otherwise(text))
    return F.concat(body, F.when(kind == "heading", "").when(together, "\n").otherwise("\n\n"))


def blocks_of(nodes: Column) -> Column:
    return F.transform(nodes, lambda n, i: block_markdown(n, F.get(nodes, i + 1)))


def markdown_of(nodes: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(blocks_of(nodes), ""), "\n{3,}", "\n\n"))


def content_nodes(pages: DataFrame) -> DataFrame:
    """Adds ``nodes``: the main-content nodes, none when the page has no prose, and ``failure``: why a page
    could not be read, or null."""
    nodes = F.col("nodes")
    pages = (pages.withColumn("nodes", html_nodes(F.col("html"))).withColumn("nodes", once(settled_nodes(nodes)))
             .withColumn("nodes", once(root_nodes(nodes)))
             .withColumn("failure", F.get(F.filter(nodes, lambda n: n["kind"] == "error"), F.lit(0))["text"]))
    return pages.withColumn("nodes", once(F.when(has_prose(nodes), nodes).otherwise(F.slice(nodes, 1, 0))))


def extract_primary(pages: DataFrame) -> DataFrame:
    """Adds ``markdown, toc, meta, title, raw_title, failure`` from the HTML."""
    nodes = F.col("nodes")
    pages = pages.withColumn("raw_title", once(page_title(F.col("html")))).withColumn(
        "meta", once(page_meta(F.col("url"), F.col("html"))))
    return (content_nodes(pages)
            .withColumn("markdown", once(markdown_of(nodes))).withColumn("toc", once(toc_of(nodes)))
            .withColumn("title", clean_title(F.col("raw_title"))).drop("nodes"))


def extract_fallback(pages: DataFrame, min_raw_text: int = MIN_RAW_TEXT) -> DataFrame:
    """Replaces ``markdown`` by that of the first adapter selector that gives any.

    Selectors are tried in order; a match counts with its own nodes, else with its raw text when that has
    at least ``min_raw_text`` characters. ``pages`` needs ``html`` and ``platform``.
    """
    def result(match: Column) -> Column:
        raw = strip(F.regexp_replace(match["content"], f"[{SPACE}]*\n[{SPACE}]*", "\n"))
        nodes = settled_nodes(match["nodes"])
        return F.when(has_prose(nodes), markdown_of(nodes)).when(
            F.length(raw) >= min_raw_text, raw).otherwise("")

    found = pages.withColumn("_matches", selected_nodes(F.col("html"), selectors_of(F.col("platform"))))
    texts = F.filter(F.transform("_matches", result), lambda text: text != "")
    return found.withColumn("markdown", F.coalesce(F.get(texts, F.lit(0)), F.lit(""))).drop("_matches")


def extract_pages(pages: DataFrame, min_raw_text: int = MIN_RAW_TEXT) -> DataFrame:
    """Primary extraction, then the selector fallback inside the same rows for pages left empty.

    The fallback call gets a null HTML for pages that are done, so they cost no second parse and no
    second scan. Fallback pages carry no table of contents and no description.
    """
    done = extract_primary(pages)
    empty = F.col("markdown") == ""
    retry = extract_fallback(done.withColumn("_html", F.col("html")).withColumn("_first", F.col("markdown"))
                             .withColumn("html", F.when(empty, F.col("html"))), min_raw_text)
    missing = F.col("_first") == ""
    return (retry.withColumn("markdown", F.when(missing, F.col("markdown")).otherwise(F.col("_first")))
            .withColumn("toc", F.when(missing, F.slice("toc", 1, 0)).otherwise(F.col("toc")))
            .withColumn("meta", F.when(missing & (F.col("markdown") == ""), F.create_map().cast("map<string,string>"))
                        .when(missing, F.create_map(F.lit("url"), F.col("url"))).otherwise(F.col("meta")))
            .withColumn("html", F.col("_html")).drop("_html", "_first"))
