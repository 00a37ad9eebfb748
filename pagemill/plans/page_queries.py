"""Registered queries for classification, metadata, extraction and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as page_fns
from ..functions import platforms
from ..functions.packing import split_oversized as cut
from ..functions.text import approx_tokens as token_estimate
from ..functions.text import overlap_tail as tail_units
from ..functions.urls import rel_path, text_page_title
from ..operators import chunking, extract
from ..operators.frontier import first_pages
from ..operators.outcome import page_outcome as outcomes_of
from . import derived as d
from . import oracle as o

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def _long(name: str):
    return F.col(name).cast("bigint").alias(name)


# The entities that occur in the data, the ampersand last; a cut-off text may lack the semicolon.
def _decoded(text: str) -> str:
    for entity, char in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&amp;?", "&")):
        text = f"regexp_replace({text}, '{entity}', '{char}', 'g')"
    return text


# classification and metadata -----------------------------------------------------------------------

_SQL_TITLE = _decoded("trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g'))")


@query("page_title", f"SELECT page_id, {_SQL_TITLE} AS title FROM pages")
def page_title(spark, sf):
    return d.rows(spark, sf, "pages").select("page_id", page_fns.page_title(F.col("html")).alias("title"))


_SQL_CLEAN = """CASE WHEN len(l) > 1 AND length(l[-1]) <= 40 AND (len(l) >= 3 OR length(l[-1]) < length(l[1])
  OR (length(l[1]) <= 12 AND length(l[-1]) > length(l[1]) * 1.5)) THEN trim(l[1]) ELSE title END"""


@query("clean_title", f"""
SELECT page_id, title, {_SQL_CLEAN} AS cleaned
FROM (SELECT *, regexp_split_to_array(title, '\\s*[|·–—:-]\\s*') AS l FROM {o.derived(d.TITLES)})""")
def clean_title(spark, sf):
    return d.derive(spark, sf, d.TITLES).select("page_id", "title", page_fns.clean_title(F.col("title")).alias("cleaned"))


@query("page_meta", f"""
SELECT page_id, url, nullif(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1), '') AS description
FROM {o.derived(d.HEAD_PAGES)}""")
def page_meta(spark, sf):
    meta = page_fns.page_meta(F.col("url"), F.col("html"))
    return d.derive(spark, sf, d.HEAD_PAGES).select(
        "page_id", meta["url"].alias("url"), meta["description"].alias("description"))


_SQL_GENERATOR = "lower(regexp_extract(html, '(?i)name=.generator. content=.([^\"'']+)', 1))"
_SQL_PLATFORM = """CASE WHEN g LIKE 'docusaurus%' THEN 'docusaurus' WHEN g LIKE 'gitbook%' THEN 'gitbook'
  WHEN g LIKE 'mkdocs%' THEN 'mkdocs' WHEN g LIKE 'sphinx%' AND instr(url, 'readthedocs') > 0 THEN 'readthedocs'
  WHEN g LIKE 'sphinx%' THEN 'sphinx' WHEN g LIKE 'vuepress%' THEN 'vuepress' WHEN g LIKE 'hugo%' THEN 'hugo'
  WHEN g LIKE 'jupyter-book%' THEN 'sphinx' WHEN instr(url, 'readthedocs') > 0 THEN 'readthedocs'
  WHEN instr(html, 'class="md-content__inner"') > 0 THEN 'mkdocs'
  WHEN instr(html, 'class="theme-default-content"') > 0 THEN 'vuepress' ELSE 'generic' END"""
_SQL_DETECTED = f"(SELECT *, {_SQL_PLATFORM} AS platform FROM (SELECT *, {_SQL_GENERATOR} AS g FROM {o.derived(d.HEAD_PAGES)}))"


@query("detect_platform", f"SELECT page_id, url, platform FROM {_SQL_DETECTED}")
def detect_platform(spark, sf):
    return d.derive(spark, sf, d.HEAD_PAGES).select(
        "page_id", "url", platforms.detect_platform(F.col("html"), F.col("url")).alias("platform"))


@query("spa_pages", f"""
SELECT page_id, url FROM {o.derived(d.HEAD_PAGES)}
WHERE instr(html, 'id="root"') + instr(html, 'id="app"') + instr(html, '__NUXT__') + instr(html, '__NEXT_DATA__') > 0""")
def spa_pages(spark, sf):
    return d.derive(spark, sf, d.HEAD_PAGES).filter(platforms.is_shell(F.col("html"))).select("page_id", "url")


# The whole text of a page's article; the driver's articles hold these tags and entities.
_ARTICLE_TEXT = "split_part(split_part(html, '<article>', 2), '</article>', 1)"
for _mark, _text in (("<h1>", "''"), ("</h1>", "chr(10)"), ("<p>", "chr(10)"), ("</p>", "''"), ("<br>", "chr(10)"), ("<b>", "''"),
                     ("&quot;", "'\"'"), ("&amp;", "'&'")):
    _ARTICLE_TEXT = f"replace({_ARTICLE_TEXT}, '{_mark}', {_text})"

# Every third page is served as the plain text of its article.
_BODIES = f"""SELECT page_id, url, status, fetched_at, CASE page_id % 3
  WHEN 1 THEN '  ' || {_ARTICLE_TEXT} || chr(10)
  WHEN 2 THEN CASE WHEN page_id % 5 = 0 THEN '<html><div id="app"></div></html>' ELSE html END
  ELSE html END AS html FROM (""" + d.RESOURCES + ") r"
_SQL_IS_HTML = "regexp_matches(lower(left(html, 512)), '<html|<!doctype|<head')"


@query("page_kind", f"""
SELECT page_id, {_SQL_IS_HTML} AS is_html, CASE WHEN NOT {_SQL_IS_HTML} THEN trim(html, ' ' || chr(10)) END AS markdown,
  regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS title
FROM {o.derived(_BODIES)}""")
def page_kind(spark, sf):
    html = page_fns.is_html(F.col("html"))
    return d.derive(spark, sf, _BODIES).select(
        "page_id", html.alias("is_html"), F.when(~html, page_fns.strip(F.col("html"))).alias("markdown"),
        text_page_title(F.col("url")).alias("title"))


# The article of a driver page: a heading, then paragraphs that may lack their end tag and open a bold run.
_SQL_PARAGRAPH = _decoded("trim(regexp_replace(replace(replace(replace(x, '</p>', ''), '<br>', ' '), chr(10), ' '), ' +', ' ', 'g'))")
_SQL_PARAGRAPHS = f"""list_filter(list_transform(list_transform(string_split(
    regexp_extract(html, '(?s)</h1>(.*?)(?:<h2>|</article>)', 1), '<p>')[2:], lambda x: {_SQL_PARAGRAPH}),
    lambda x: CASE WHEN x LIKE '<b>%' THEN '**' || trim(substr(x, 4)) || '**' ELSE x END), lambda x: x <> '')"""
_SQL_HEADING = _decoded("trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g'))")


def _sql_article(source: str) -> str:
    return f"(SELECT *, {_SQL_HEADING} AS heading, {_SQL_PARAGRAPHS} AS paragraphs FROM {source})"


_SQL_MARKDOWN = "'# ' || heading || chr(10) || array_to_string(paragraphs, chr(10) || chr(10))"


@query("page_outcome", f"""
SELECT page_id, status::BIGINT AS status, CASE WHEN status <> 200 THEN 'HTTP ' || status WHEN shell THEN 'empty extraction' ELSE '' END AS error,
  status = 200 AND shell AS needs_render, CASE WHEN status <> 200 OR shell THEN '' WHEN is_html THEN {_SQL_MARKDOWN}
  ELSE trim(html, ' ' || chr(10)) END AS markdown
FROM {_sql_article(f"(SELECT *, {_SQL_IS_HTML} AS is_html, instr(html, 'id=' || chr(34) || 'app') > 0 AS shell FROM {o.derived(_BODIES)})")}""")
def page_outcome(spark, sf):
    found = d.derive(spark, sf, _BODIES).select(F.lit("all").alias("site"), F.col("page_id").alias("ord"), "url", "status",
                                                "html", "fetched_at", F.lit("generic").alias("platform"))
    return outcomes_of(found).select(F.col("ord").alias("page_id"), _long("status"), "error", "needs_render", "markdown")


# extraction ----------------------------------------------------------------------------------------

@query("content_nodes", f"""
SELECT page_id, 0::BIGINT AS node_no, 'heading' AS kind, 1::BIGINT AS level, heading AS text FROM {_sql_article('pages')}
UNION ALL SELECT page_id, generate_subscripts(paragraphs, 1)::BIGINT, 'para', 0, unnest(paragraphs) FROM {_sql_article('pages')}""")
def content_nodes(spark, sf):
    """The article's nodes, whether its page is well formed or leaves noise unclosed."""
    return (extract.content_nodes(d.derive(spark, sf, d.UNCLOSED_PAGES)).select("page_id", F.posexplode("nodes").alias("node_no", "n"))
            .select("page_id", _long("node_no"), "n.kind", F.col("n.level").cast("bigint").alias("level"), "n.text"))


_RICH = f"(SELECT *, page_id * 7 AS n, split_part(url, '/', 3) AS w FROM {_sql_article(o.derived(d.RICH_PAGES))})"
_NL = "chr(10)"
_SQL_RICH_BLOCKS = {
    "inline": "'See [the **page**](/' || n || '), `f(' || n || ')`, *now* or ~~never~~.'",
    "code": f"'```' || {_NL} || 'x = ' || n || {_NL} || '  y = 2' || {_NL} || '```'",
    "list": f"'- one ' || w || {_NL} || '- two' || {_NL} || '  1. sub ' || n || {_NL} || '  2. last'",
    "quote": f"'> first' || {_NL} || '> ' || w",
    "table": (f"'| Key | a\\|b |  |' || {_NL} || '| --- | --- | --- |' || {_NL} || '| ' || w || ' |  |  |' || {_NL} "
              f"|| '| 1 | ' || n || ' | 3 |'"),
}
_SQL_RICH = (f"{_SQL_MARKDOWN} || {_NL} || {_NL} || '## Part ' || w || {_NL} || "
             + f" || {_NL} || {_NL} || ".join(_SQL_RICH_BLOCKS.values()))


def _rich(spark, sf):
    return d.derive(spark, sf, d.RICH_PAGES)


def _rich_blocks(spark, sf):
    nodes = extract.content_nodes(_rich(spark, sf)).withColumn("blocks", extract.blocks_of(F.col("nodes")))
    return nodes.select("page_id", F.posexplode(F.arrays_zip("nodes", "blocks")).alias("block_no", "b")).select(
        "page_id", "block_no", F.col("b.nodes.kind").alias("kind"), F.col("b.blocks").alias("block"))


@query("blocks_markdown", f"""
SELECT page_id, kind, block FROM (
  SELECT page_id, 'heading' AS kind, {_NL} || '# ' || heading || {_NL} AS block FROM {_RICH}
  UNION ALL SELECT page_id, 'heading', {_NL} || '## Part ' || w || {_NL} FROM {_RICH}
  UNION ALL SELECT page_id, 'para', unnest(paragraphs) || {_NL} || {_NL} FROM {_RICH}
  UNION ALL SELECT page_id, 'para', {_SQL_RICH_BLOCKS['inline']} || {_NL} || {_NL} FROM {_RICH}
  UNION ALL SELECT page_id, 'code', {_SQL_RICH_BLOCKS['code']} || {_NL} || {_NL} FROM {_RICH}
  UNION ALL SELECT page_id, 'quote', {_SQL_RICH_BLOCKS['quote']} || {_NL} || {_NL} FROM {_RICH})""")
def blocks_markdown(spark, sf):
    return _rich_blocks(spark, sf).filter(~F.col("kind").isin("item", "table")).select("page_id", "kind", "block")


@query("list_markdown", f"""
SELECT page_id, unnest(string_split({_SQL_RICH_BLOCKS['list']}, {_NL})) AS item FROM {_RICH}""")
def list_markdown(spark, sf):
    return extract.content_nodes(_rich(spark, sf)).select("page_id", F.explode(F.transform(
        F.filter("nodes", lambda n: n["kind"] == "item"), extract.list_item)).alias("item"))


@query("table_markdown", f"SELECT page_id, {_SQL_RICH_BLOCKS['table']} AS markdown FROM {_RICH}")
def table_markdown(spark, sf):
    return extract.content_nodes(_rich(spark, sf)).select("page_id", F.explode(F.transform(
        F.filter("nodes", lambda n: n["kind"] == "table"), lambda n: extract.table_markdown(n["rows"]))).alias("markdown"))


@query("page_toc", f"""
SELECT page_id, 0::BIGINT AS pos, 1::BIGINT AS level, heading AS title, '' AS anchor FROM {_RICH}
UNION ALL SELECT page_id, 1, 2, 'Part ' || w, '' FROM {_RICH}""")
def page_toc(spark, sf):
    toc = extract.content_nodes(_rich(spark, sf)).withColumn("toc", extract.toc_of(F.col("nodes")))
    return toc.select("page_id", F.posexplode("toc").alias("pos", "t")).select(
        "page_id", _long("pos"), F.col("t.level").cast("bigint").alias("level"), "t.title", "t.anchor")


@query("page_markdown", f"SELECT page_id, {_SQL_RICH} AS markdown, trim({_SQL_TITLE}) AS raw_title FROM {_RICH}")
def page_markdown(spark, sf):
    return extract.extract_primary(_rich(spark, sf)).select("page_id", "markdown", "raw_title")


# A list of links has no prose: its raw text counts when it is long enough.
_SQL_LABELS = _decoded("trim(regexp_replace(split_part(split_part(html, '<nav>', 2), '</nav>', 1), '<[^>]+>', '', 'g'))")
_SQL_AD = _decoded("trim(regexp_replace(split_part(split_part(html, '<div class=\"ad\">', 2), '</div>', 1), '\\s+', ' ', 'g'))")


@query("extract_fallback", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN {_SQL_MARKDOWN} WHEN 1 THEN CASE WHEN length(raw) >= 50 THEN raw ELSE '' END
  WHEN 2 THEN ad || {_NL} || {_NL} || {_SQL_MARKDOWN}
  ELSE CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN {_SQL_MARKDOWN} ELSE 'intro text' END END AS markdown
FROM (SELECT *, {_SQL_LABELS} AS raw, {_SQL_AD} AS ad FROM {_sql_article('pages')})""")
def extract_fallback(spark, sf):
    return extract.extract_fallback(d.derive(spark, sf, d.FALLBACK_PAGES)).select("page_id", "markdown")


# chunking ------------------------------------------------------------------------------------------

# The text, and the text with each vowel doubled by a CJK sign.
_MIXED = """SELECT doc_id, text FROM {documents} UNION ALL
SELECT doc_id, replace(replace(text, 'e', 'e字'), '.', '。') AS text FROM {documents}"""


@query("approx_tokens", f"SELECT doc_id, {o.tokens('text')}::BIGINT AS tokens FROM {o.derived(_MIXED)}")
def approx_tokens(spark, sf):
    return d.derive(spark, sf, _MIXED).select("doc_id", token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query("overlap_tail", f"""
SELECT doc_id, array_to_string(regexp_extract_all(text, '{o.CJK}|[A-Za-z0-9_]+|.')[-120:], '') AS tail FROM {o.derived(_MIXED)}""")
def overlap_tail(spark, sf):
    return d.derive(spark, sf, _MIXED).select("doc_id", tail_units(F.col("text"), 120).alias("tail"))


_LEVELS = range(1, 7)
_SQL_BLOCKS = f"""(
WITH lines AS (SELECT doc_id, site, unnest(l) AS line, generate_subscripts(l, 1) AS no FROM
       (SELECT doc_id, site, string_split(markdown, chr(10)) AS l FROM {o.derived(d.MARKDOWN)})),
     marked AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level FROM lines),
     placed AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS block,
       {', '.join(f"max(CASE WHEN level = {k} THEN no END) OVER w AS p{k}" for k in _LEVELS)},
       {', '.join(f"last_value(CASE WHEN level = {k} THEN trim(substr(line, {k + 1})) END IGNORE NULLS) OVER w AS t{k}" for k in _LEVELS)}
       FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING)),
     paths AS (SELECT *, list_filter([{', '.join(
         f"CASE WHEN p{k} > greatest(0, {', '.join(f'coalesce(p{j}, 0)' for j in range(1, k)) or '0'}) THEN t{k} END"
         for k in _LEVELS)}], lambda t: t IS NOT NULL) AS path FROM placed)
SELECT doc_id, site, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS block_no, path, text FROM
  (SELECT doc_id, site, block, arg_min(path, no) AS path, trim(string_agg(line, chr(10) ORDER BY no), ' ' || chr(10)) AS text
   FROM paths GROUP BY ALL))"""


@query("split_blocks", f"""
SELECT doc_id, block_no::BIGINT AS block_no, array_to_string(path, ' > ') AS heading_path, text FROM {_SQL_BLOCKS}""")
def split_blocks(spark, sf):
    docs = d.derive(spark, sf, d.MARKDOWN)
    return docs.select("doc_id", F.posexplode(chunking.split_blocks(F.col("markdown"))).alias("block_no", "b")).select(
        "doc_id", _long("block_no"), F.array_join("b.heading_path", " > ").alias("heading_path"), "b.text")


@query("split_oversized", f"""
WITH RECURSIVE big AS MATERIALIZED (SELECT doc_id AS doc, 0 AS block, text FROM documents WHERE {o.tokens('text')} > 200),{o.cut_ctes(200)}
SELECT doc_id, piece_no - 1 AS piece_no, {o.tokens('text')}::BIGINT AS tokens, text FROM (
  SELECT doc AS doc_id, generate_subscripts(pieces, 1)::BIGINT AS piece_no, unnest(pieces) AS text FROM cut_pieces
  UNION ALL SELECT doc_id, 1, text FROM documents WHERE {o.tokens('text')} <= 200)""")
def split_oversized(spark, sf):
    pieces = d.rows(spark, sf, "documents").select("doc_id", F.posexplode(cut(F.col("text"), 200)).alias("piece_no", "text"))
    return pieces.select("doc_id", _long("piece_no"), token_estimate(F.col("text")).cast("bigint").alias("tokens"), "text")


def _chunks(spark, sf):
    docs = d.derive(spark, sf, d.MARKDOWN)
    return chunking.chunk_documents(docs.select("doc_id", "site", "url", "markdown"), 400, 40)


_SQL_CHUNKS = "(" + o.chunks(f"(SELECT doc_id AS doc, block_no AS block, path, text FROM {_SQL_BLOCKS})", 400, 40) + ")"


@query("chunk_documents", f"""
SELECT doc AS doc_id, seq::BIGINT AS seq, array_to_string(path, ' > ') AS heading_path, tokens::BIGINT AS tokens, text FROM {_SQL_CHUNKS}""")
def chunk_documents(spark, sf):
    return _chunks(spark, sf).select("doc_id", _long("seq"), F.array_join("heading_path", " > ").alias("heading_path"),
                                     _long("tokens"), "text")


# flagship ------------------------------------------------------------------------------------------

# The first page of every canonical URL and its markdown; a driver page is one block below its heading.
_SQL_FIRST = f"""(SELECT * EXCLUDE (canonical, url), canonical AS url, row_number() OVER (ORDER BY page_id) AS doc FROM (
  SELECT * FROM {o.with_canonical(_sql_article("pages"))} QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id) = 1))"""
_SQL_PAGE_BLOCKS = f"(SELECT doc, 0 AS block, [heading] AS path, {_SQL_MARKDOWN} AS text FROM {_SQL_FIRST})"


@query("corpus", f"""
SELECT split_part(url, '/', 3) AS site, url, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '\\.html$', '') AS path,
  {_SQL_CLEAN} AS title, seq::BIGINT AS seq, array_to_string(c.path, ' > ') AS heading_path, tokens::BIGINT AS tokens, text
FROM ({o.chunks(_SQL_PAGE_BLOCKS, 1500, 120)}) c JOIN (
  SELECT doc, url, title, regexp_split_to_array(title, '\\s*[|·–—:-]\\s*') AS l FROM (SELECT doc, url, {_SQL_TITLE} AS title FROM {_SQL_FIRST})) USING (doc)""")
def corpus(spark, sf):
    """Canonical, deduplicated pages as token-bounded chunks: the whole path from HTML to corpus rows."""
    pages = d.rows(spark, sf, "pages").select(F.expr("split_part(url, '/', 3)").alias("site"),
                                               F.col("page_id").alias("ord"), "url", "html")
    pages = extract.extract_primary(first_pages(pages)).withColumn("path", rel_path(F.col("url")))
    return chunking.chunk_documents(pages.select("site", "url", "path", "title", "markdown")).select(
        "site", "url", "path", "title", _long("seq"), F.array_join("heading_path", " > ").alias("heading_path"),
        _long("tokens"), "text")
