"""Inputs the registered queries derive from the driver tables.

Each text is one SELECT in the SQL both Spark and the oracle understand, so both sides derive the same
rows. ``{pages}`` and ``{documents}`` stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

_HOST = "split_part(url, '/', 3)"
_BARE = "split_part(split_part(url, '?', 1), '#', 1)"
_SECURE = "url LIKE 'https:%'"

# URLs in all the shapes canonicalisation has to deal with.
RAW_URLS = f"""
SELECT page_id, {_HOST} AS site, CASE page_id % 8
  WHEN 1 THEN '  ' || url || '  '
  WHEN 2 THEN replace(replace(url, 'https://', 'HTTPS://'), 'http://', 'Http://')
  WHEN 3 THEN CASE WHEN {_SECURE} THEN 'https://' ELSE 'http://' END || upper({_HOST})
       || CASE WHEN {_SECURE} THEN ':443/' ELSE ':80/' END || split_part(url, '/', 4) || '/' || split_part(url, '/', 5)
  WHEN 4 THEN {_BARE} || '/index.html'
  WHEN 5 THEN {_BARE} || '?utm=1&hl=fr&version=2&lang=&v=3#x'
  WHEN 6 THEN 'ftp://' || {_HOST} || '/x'
  WHEN 7 THEN {_BARE} || '///'
  ELSE url END AS url
FROM {{pages}}"""

# Paths that hit every filter rule, with an adapter per row.
CHECKED_URLS = f"""
SELECT page_id, split_part(url, '/', 4) AS lang,
  'https://' || {_HOST} || '/' || split_part(url, '/', 4) || CASE page_id % 13
  WHEN 1 THEN '/guide.PDF' WHEN 2 THEN '/feedback' WHEN 3 THEN '/_static/a' WHEN 4 THEN '/tags/x'
  WHEN 5 THEN '/notes.md' WHEN 6 THEN '/search.html' WHEN 7 THEN '/a.tar.gz' WHEN 8 THEN '/~gitbook/x'
  WHEN 9 THEN '/private/x' WHEN 10 THEN '/v1.2/page' WHEN 11 THEN '/login'
  ELSE '/' || split_part({_BARE}, '/', 5) END AS url,
  CASE page_id % 5 WHEN 0 THEN 'generic' WHEN 1 THEN 'sphinx' WHEN 2 THEN 'docusaurus' WHEN 3 THEN 'mkdocs'
  ELSE 'gitbook' END AS adapter
FROM {{pages}}"""

# Names that output paths have to make safe.
PATH_URLS = f"""
SELECT page_id, 'https://' || {_HOST} || CASE page_id % 11
  WHEN 1 THEN '/' WHEN 2 THEN '/docs/CON' WHEN 3 THEN '/a//b.HTML' WHEN 4 THEN '/a:b|c/d*e.txt'
  WHEN 5 THEN '/x/index.htm' WHEN 6 THEN '/x/Index' WHEN 7 THEN '/ . /lpt1.xhtml' WHEN 8 THEN '/v1. /z?q=1'
  WHEN 9 THEN '/' || repeat('ab', 120) || '/k' WHEN 10 THEN '/index.html'
  ELSE '/' || split_part(url, '/', 4) || '/' || split_part({_BARE}, '/', 5) END AS url
FROM {{pages}}"""

# One fetched resource per page.
RESOURCES = """
SELECT page_id, url, CASE page_id % 10 WHEN 3 THEN 404 WHEN 7 THEN 500 ELSE 200 END AS status, html,
  CAST(1700000000 + page_id * 60 AS DOUBLE) AS fetched_at
FROM {pages}"""

# One site per host, started at its first language section.
SITES = f"""
SELECT {_HOST} AS site, 'https://' || {_HOST} || '/' || min(split_part(url, '/', 4)) || '/' AS url,
  'auto' AS adapter, 'generic' AS platform, CAST(NULL AS STRING) AS include_re, CAST(NULL AS STRING) AS exclude_re,
  3 AS max_pages, 0 AS max_depth
FROM {{pages}} GROUP BY 1"""

# Pages whose head carries a generator, a DOM hint or a script container, and sometimes a description.
HEAD_PAGES = """
SELECT page_id, CASE WHEN page_id % 11 = 5 THEN replace(url, '.example.', '.readthedocs.') ELSE url END AS url,
  CASE WHEN page_id % 17 = 0 THEN '<div id="root"></div><script>window.__INITIAL_STATE__=1</script>'
  ELSE replace(html, '<head>', '<head>' || CASE page_id % 12
    WHEN 1 THEN '<meta name="generator" content="Docusaurus v3">'
    WHEN 2 THEN '<meta name="generator" content="Sphinx 8.1">'
    WHEN 3 THEN '<META NAME="Generator" CONTENT="MkDocs 1.6">'
    WHEN 4 THEN '<meta name="generator" content="GitBook">'
    WHEN 5 THEN '<meta name=' || chr(39) || 'generator' || chr(39) || ' content=' || chr(39) || 'Sphinx 7' || chr(39) || '>'
    WHEN 6 THEN '<meta name="generator" content="VuePress 2">'
    WHEN 7 THEN '<meta name="generator" content="Hugo 0.1">'
    WHEN 8 THEN '<meta name="generator" content="Jupyter-Book 1">'
    WHEN 9 THEN '<div class="theme-default-content"></div>'
    WHEN 10 THEN '<div class="md-content__inner"></div>'
    ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '<meta name="description" content="' || repeat(url || ' ', 8) || '">'
    ELSE '' END) END AS html
FROM {pages}"""

# Titles with every separator.
TITLES = """
SELECT page_id, CASE page_id % 7 WHEN 1 THEN t || ' | Docs' WHEN 2 THEN t || ' - Guide - Example Site'
  WHEN 3 THEN 'API: ' || t WHEN 4 THEN 'A' || ' · ' || t WHEN 5 THEN t || ' — ' || t
  WHEN 6 THEN 'real-time systems' ELSE t END AS title
FROM (SELECT page_id, split_part(split_part(html, '<h1>', 2), '</h1>', 1) AS t FROM {pages}) s"""

# Articles closed by one block of every kind; the texts come from the page.
RICH_PAGES = """
SELECT page_id, url, replace(html, '</article>', '<h2>Part ' || w || '¶</h2><p>See <a href="/' || n
  || '">the <b>page</b></a>, <code>f(' || n || ')</code>, <em>now</em> or <del>never</del>.</p><pre><code>' || chr(10)
  || 'x = ' || n || chr(10) || '  y = 2' || chr(10) || '</code></pre><ul><li>one ' || w
  || '</li><li>two<ol><li>sub ' || n || '</li><li>last</li></ol></li></ul><blockquote><p>first</p><p>' || w
  || '</p></blockquote><table><tr><th>Key</th><th>a|b</th></tr><tr><td>' || w || '</td></tr><tr><td>1</td><td>' || n
  || '</td><td>3</td></tr></table></article>') AS html
FROM (SELECT page_id, url, html, CAST(page_id * 7 AS STRING) AS n, split_part(url, '/', 3) AS w FROM {pages}) s"""

# The platform's element instead of the page's article, around its own link list or around its whole body; or a
# page that opens with a root of its own.
_ELEMENT = """'<div class="' || CASE page_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'markdown' ELSE 'markdown-section' END || '">'"""
_PLAIN = "replace(replace(html, '<article>', '<section>'), '</article>', '</section>')"
FALLBACK_PAGES = f"""
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'sphinx' WHEN 1 THEN 'docusaurus' ELSE 'gitbook' END AS platform,
  CASE page_id % 4 WHEN 0 THEN replace(replace(html, '<article>', {_ELEMENT}), '</article>', '</div>')
  WHEN 1 THEN replace(replace({_PLAIN}, '<nav>', {_ELEMENT}), '</nav>', '</div>')
  WHEN 2 THEN replace(replace({_PLAIN}, '<body>', '<body>' || {_ELEMENT}), '</body>', '</div></body>')
  ELSE replace(html, '<body>', '<body><main><p>intro text</p></main>') END AS html
FROM {{pages}}"""

# Every page's article in a page whose head, navigation or controls lack their end tags.
_ARTICLE = "split_part(split_part(html, '<article>', 2), '</article>', 1)"
_MENU = "'<nav><ul><li><a href=\"/a\">Home</a></li><li><a href=\"/b\">Documents</a></li></ul>'"
UNCLOSED_PAGES = f"""
SELECT page_id, url, CASE page_id % 7 WHEN 1 THEN '<html><head><title>t</title>' || {_ARTICLE}
  WHEN 2 THEN '<html><body>' || {_MENU} || '<div>' || {_ARTICLE} || '</div></body></html>'
  WHEN 3 THEN '<html><body><div>' || {_MENU} || '</div><div>' || {_ARTICLE} || '</div></body></html>'
  WHEN 4 THEN '<html><body><select><option>English<option>French<div>' || {_ARTICLE} || '</div></body></html>'
  WHEN 5 THEN '<html><body><button>Menu<div>' || {_ARTICLE} || '</div></body></html>'
  WHEN 6 THEN '<html><body><p>out</p><main><aside>' || {_ARTICLE} || '</main><p>out</p></body></html>'
  ELSE html END AS html
FROM {{pages}}"""

# A document tree on one host: page i links to 2i+1, 2i+2 and back to i/3, besides its own links.
GRAPH_PAGES = """
SELECT 'https://docs.example.org/p/' || CAST(page_id AS STRING) AS url,
  CASE page_id % 10 WHEN 9 THEN 404 ELSE 200 END AS status,
  replace(html, '</article>', '<a href="' || CAST(2 * page_id + 1 AS STRING) || '">l</a><a href="/p/'
    || CAST(2 * page_id + 2 AS STRING) || '?ref=x">r</a><a href="https://docs.example.org/p/'
    || CAST(CAST(floor(page_id / 3) AS BIGINT) AS STRING) || '#up">u</a></article>') AS html
FROM {pages}"""

# Every page has its own sitemap file with two child files, its page on a shared host and its page as it is.
SITEMAPS = f"""
SELECT page_id, 'https://docs.example.org/sitemap-' || CAST(page_id AS STRING) || '.xml' AS url, 200 AS status,
  CASE WHEN page_id % 19 = 18 THEN '<urlset><loc>broken' ELSE
  '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://docs.example.org/'
  || split_part(url, '/', 4) || '/' || split_part({_BARE}, '/', 5) || '/</loc></url><url><loc>'
  || replace(url, '&', '&amp;') || '</loc></url><sitemap><loc>https://docs.example.org/sitemap-'
  || CAST(2 * page_id + 1 AS STRING) || '.xml</loc></sitemap><sitemap><loc>https://docs.example.org/'
  || CASE WHEN page_id % 4 = 1 THEN 'Sitemap-' || CAST(2 * page_id + 2 AS STRING) || '.XML'
  ELSE 'sitemap-' || CAST(2 * page_id + 2 AS STRING) || '.xml' END || '</loc></sitemap></urlset>' END AS html
FROM {{pages}}"""

# One site per page, with the text of its llms.txt and robots.txt.
TEXT_SITES = f"""
SELECT 'p' || CAST(page_id AS STRING) AS site, 'https://p' || CAST(page_id AS STRING) || '.' || {_HOST} || '/docs/' AS url,
  CASE page_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'llmstxt' ELSE 'sphinx' END AS adapter, 'generic' AS platform,
  CAST(NULL AS STRING) AS include_re, CAST(NULL AS STRING) AS exclude_re, 0 AS max_pages, 0 AS max_depth,
  CASE WHEN page_id % 4 = 1 THEN chr(10) || 'no links here' ELSE
  '# ' || {_HOST} || chr(10) || '- [Guide](/docs/g' || CAST(page_id AS STRING) || '.md): all' || chr(10)
  || CASE WHEN page_id % 4 = 2 THEN '' ELSE '- [Full](llms-full.txt)' || chr(10) END
  || '![img](https://p' || CAST(page_id AS STRING) || '.' || {_HOST} || '/docs/i/) [other](' || url || ')' || chr(10)
  || '  https://p' || CAST(page_id AS STRING) || '.' || {_HOST} || '/raw.md..' || chr(10) || 'not a link' || chr(10)
  || '/search [s](/search)' END AS llms,
  CASE WHEN page_id % 5 = 4 THEN '' ELSE 'whole ' || {_HOST} || chr(10) END AS llms_full,
  'User-agent: *' || chr(10) || 'Sitemap: https://p' || CAST(page_id AS STRING) || '.' || {_HOST} || '/sitemap.xml'
  || chr(10) || 'SITEMAP:  /maps/' || CAST(page_id AS STRING) || '.xml ' || chr(10) || 'Disallow: /x' AS robots
FROM {{pages}}"""

# Documents as markdown: heading lines, chosen by the first letter of a line, and blank lines are put in.
MARKDOWN = """
SELECT doc_id, source AS site, 'https://' || source || '.example.org/d/' || CAST(doc_id AS STRING) AS url,
  '# ' || source || chr(10) || chr(10) ||
  replace(replace(replace(replace(replace(text, chr(10), chr(10) || chr(10)),
    chr(10) || 'D', chr(10) || '## Part D' || chr(10) || chr(10) || 'D'),
    chr(10) || 'L', chr(10) || '###  Leaf ' || lang || ' ' || chr(10) || 'L'),
    chr(10) || 'T', chr(10) || '## Topic' || chr(10) || '#### Deep' || chr(10) || '#none' || chr(10) || 'T'),
    chr(10) || 'E', chr(10) || '# Entry' || chr(10) || 'E') AS markdown
FROM {documents}"""

# Documents as page rows of their source, with failures, empty pages and shared output paths.
PAGE_ROWS = """
SELECT source AS site, doc_id AS ord, 'https://' || source || '.example.org/d/' || CAST(doc_id AS STRING) AS url,
  'd/' || CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS STRING) AS path,
  'Doc: ' || lang || chr(10) || '---' AS title, CASE WHEN doc_id % 23 = 5 OR doc_id % 9 = 4 THEN '' ELSE text END AS markdown,
  CASE WHEN doc_id % 9 = 4 THEN 'HTTP 404' ELSE '' END AS error, CAST(1700000000 + n_chars AS DOUBLE) AS fetched_at
FROM {documents}"""

# One site per document source.
DOC_SITES = """
SELECT DISTINCT source AS site, 'https://' || source || '.example.org/' AS url, 'generic' AS adapter FROM {documents}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for per-row work: spread over all cores."""
    return spread(table(spark, sf_dir, name))


def derive(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    name = "documents" if "{documents}" in text else "pages"
    return spark.sql(text, **{name: rows(spark, sf_dir, name)})


def for_oracle(text: str) -> str:
    return "(" + text.format(pages="pages", documents="documents") + ")"
