"""Registered queries for sinks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, reports
from ..session import scratch_path
from ..sources import sinks
from . import derived as d
from . import oracle as o
from .page_queries import _SQL_CHUNKS, _chunks
from .url_queries import _SQL_SORTED, _sorted

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def page_rows(spark, sf):
    """Document rows with the table of contents and metadata of page rows."""
    return (d.derive(spark, sf, d.PAGE_ROWS)
            .withColumn("toc", F.array(F.struct(F.lit(1).alias("level"), F.col("site").alias("title"), F.lit("").alias("anchor"))))
            .withColumn("meta", F.create_map(F.lit("url"), F.col("url"))))


def doc_sites(spark, sf):
    return d.derive(spark, sf, d.DOC_SITES)


_ROWS = o.derived(d.PAGE_ROWS)
_FULL = f"(SELECT * FROM {_ROWS} WHERE error = '' AND markdown <> '')"
_LAST = f"(SELECT * FROM {_FULL} QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY ord DESC) = 1)"
_JSON = ("to_json({url: url, path: path, title: title, toc: [{level: 1, title: site, anchor: ''}], meta: {url: url}, "
         "markdown: markdown})::VARCHAR")


@query("render_markdown", f"""
SELECT site, path || '.md' AS path, '---' || chr(10) || 'title: ' || replace(replace(replace(title, chr(10), ' '), ':', ' -'), '---', '—')
  || chr(10) || 'url: ' || url || chr(10) || 'source: https://' || site || '.example.org/' || chr(10) || '---' || chr(10) || chr(10)
  || markdown || chr(10) AS content FROM {_LAST}""")
def render_markdown(spark, sf):
    return sinks.markdown_files(page_rows(spark, sf), doc_sites(spark, sf))


@query("page_json", f"SELECT site, path || '.json' AS path, {_JSON} AS json FROM {_LAST}")
def page_json(spark, sf):
    path = scratch_path(spark, "page-json")
    sinks.write_by_site(sinks.page_json(page_rows(spark, sf)), path, ["path"])
    return spark.read.schema("path string, json string, site string").json(path)


@query("site_corpus", f"""
SELECT site, 1::BIGINT AS part, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY site) THEN '' ELSE ',' END || {_JSON} AS text FROM {_FULL}
UNION ALL SELECT site, 0, 0, '{{"site":"' || site || '","url":"' || url || '","adapter":"generic","generated_at":"2026-01-01T00:00:00","pages":['
  FROM {o.derived(d.DOC_SITES)} UNION ALL SELECT site, 2, 0, ']}}' FROM {o.derived(d.DOC_SITES)}""")
def site_corpus(spark, sf):
    rows = sinks.site_json(page_rows(spark, sf), doc_sites(spark, sf), "2026-01-01T00:00:00")
    return rows.withColumn("part", F.col("part").cast("bigint"))


@query("site_corpus_md", f"""
SELECT site, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY site) THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) END
  || '# ' || title || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || markdown AS text FROM {_FULL}""")
def site_corpus_md(spark, sf):
    return sinks.site_markdown(page_rows(spark, sf)).select("site", "ord", "text")


@query("corpus_jsonl", f"""
SELECT site, url, 'd/' || doc AS path, site AS title, seq::BIGINT AS seq, array_to_string(path, ' > ') AS heading_path,
  tokens::BIGINT AS tokens, text
FROM {_SQL_CHUNKS} JOIN (SELECT doc_id AS doc, site, url FROM {o.derived(d.MARKDOWN)}) USING (doc)""")
def corpus_jsonl(spark, sf):
    path = scratch_path(spark, "corpus-jsonl")
    chunks = _chunks(spark, sf).withColumn("path", F.concat(F.lit("d/"), "doc_id")).withColumn("title", F.col("site"))
    sinks.write_corpus(chunks.drop("doc_id"), path)
    return sinks.read_corpus(spark, path).select(
        "site", "url", "path", "title", F.col("seq").cast("bigint").alias("seq"),
        F.array_join("heading_path", " > ").alias("heading_path"), F.col("tokens").cast("bigint").alias("tokens"), "text")


@query("corpus_stats", f"""
SELECT site, count(*)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens
FROM {_SQL_CHUNKS} JOIN (SELECT doc_id AS doc, site FROM {o.derived(d.MARKDOWN)}) USING (doc) GROUP BY site""")
def corpus_stats(spark, sf):
    return chunking.corpus_stats(_chunks(spark, sf).select("site", "tokens"))


_SQL_MANIFEST = f"""SELECT site AS name, url, adapter, site AS out_dir, count(*) FILTER (error = '')::BIGINT AS pages,
  count(*) FILTER (error <> '')::BIGINT AS failed, min(fetched_at) AS started_at, max(fetched_at) AS finished_at,
  'sitemap' AS source FROM {_ROWS} r JOIN {o.derived(d.DOC_SITES)} s USING (site) GROUP BY ALL"""
_SQL_MANIFEST = _SQL_MANIFEST.replace("SELECT site AS name, url,", "SELECT site AS name, s.url,")


def _manifest(spark, sf):
    sites = doc_sites(spark, sf)
    return reports.manifest(page_rows(spark, sf), sites, sites.select("site", F.lit("sitemap").alias("source")))


@query("manifest", _SQL_MANIFEST)
def manifest(spark, sf):
    return _manifest(spark, sf)


@query("manifest_urls", f"""
SELECT site, CASE error WHEN '' THEN 'urls' ELSE 'failed_urls' END AS list, ord, url, error FROM {_ROWS}""")
def manifest_urls(spark, sf):
    return reports.manifest_urls(page_rows(spark, sf))


@query("manifest_list", _SQL_MANIFEST)
def manifest_list(spark, sf):
    path = scratch_path(spark, "manifests")
    sinks.write_manifest(_manifest(spark, sf), reports.manifest_urls(page_rows(spark, sf)), path)
    return sinks.read_manifests(spark, f"{path}/sites/*").drop("file")


@query("run_summary", f"""
WITH c AS (SELECT site, count(*) FILTER (error = '') AS pages, count(*) FILTER (error <> '') AS failed FROM {_ROWS} GROUP BY site),
  f AS (SELECT site, ord, url, error FROM {_ROWS} WHERE error <> '' QUALIFY row_number() OVER (PARTITION BY site ORDER BY ord) <= 10)
SELECT site, pages, failed, ord, url, error, greatest(failed - 10, 0)::BIGINT AS more FROM c LEFT JOIN f USING (site)""")
def run_summary(spark, sf):
    return reports.run_summary(page_rows(spark, sf))


@query("inspect_urls", f"""
SELECT site, 'sitemap' AS source, count(*) OVER (PARTITION BY site)::BIGINT AS total, ord::BIGINT AS ord, url FROM {_SQL_SORTED}
QUALIFY ord <= 30""")
def inspect_urls(spark, sf):
    return reports.inspect_urls(_sorted(spark, sf).withColumn("source", F.lit("sitemap")))
