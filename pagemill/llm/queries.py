"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune
from . import (ball_tree, bayes_dedup, lattice_sampling, length_histogram, order_minhash, pq_dedup, secret_links, site_lines,
               subword_classifier, suffix_dedup, turn_repair, url_aliases, weighted_mix)
from .common import table


def op1_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return (url_aliases.judge_urls(pages, url_aliases.url_edges(pages))
            .select("page_id", "host", "path", "rule", "verdict", "propagated"))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{name}") for i, (name, _) in enumerate(secret_links.BASE)),
        F.sha2(secret_links.span_string(F.col("base")), 256).alias("base_sha256"),
        secret_links.span_string(F.concat("base", "linked")).alias("spans"),
        F.size("linked").cast("bigint").alias("n_linked"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))
    return printed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        order_minhash.fingerprint_string(F.col("sketch")).alias("fingerprint"),
        order_minhash.fingerprint_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        order_minhash.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        order_minhash.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op4_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.count_tokens(spark, table(spark, sf_dir, "documents"))


def op5_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lattice_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = lattice_sampling.load_vocabulary(f"{lattice_sampling.TOKENIZERS}/{lattice_sampling.MODEL}")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    found = lattice_sampling.encode_samples(docs, vocabulary, carry=("text_hash",), unit_chars=1_200_000)
    return found.select(
        "doc_id", "sample", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob",
        "inclusion", (F.xxhash64(lattice_sampling.decode_ids(F.col("ids"), vocabulary)) == F.col("text_hash")).alias("round_trip"))


def op7_bayes_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bayes_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return site_lines.drop_boilerplate(docs).select(
        "doc_id", F.col("_lines").cast("bigint").alias("n_lines"), F.col("_dropped").cast("bigint").alias("n_dropped"),
        F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.linked_vectors(table(spark, sf_dir, "embeddings"))


def op10_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_mix.mix_sources(table(spark, sf_dir, "documents")).drop("_row")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda s: s["end"] - s["start"]
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + size(s)).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")), copy="_copy", dropped="_dropped")


_QUERIES = (op1_url_aliases, op2_secret_links, op3_order_minhash, op4_length_histogram, op5_subword_classifier,
            op6_lattice_sampling, op7_bayes_dedup, op8_site_lines, op9_pq_dedup, op10_weighted_mix, op11_suffix_dedup,
            op12_ball_tree, op13_turn_repair)

# The tables' pages name no redirects and no canonical links, so every class here is one URL form and its URLs.
_ORACLE_1 = """
WITH raw AS (SELECT page_id, url, url LIKE '%://%' AS known, regexp_extract(url, '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT page_id, url, known,
  CASE WHEN known THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN known THEN regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM raw),
rules(action, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                          ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, arg_max(struct_pack(r := h || pre, a := action), length(h || pre)) AS f
        FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, pre) GROUP BY page_id),
node AS (SELECT p.*, f.r AS rule, f.a AS own, CASE WHEN known THEN host
  || regexp_replace(regexp_replace(path, '/index\\.html?$', ''), '/+$', '')
  || coalesce('?' || nullif(trim(regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1),
       '(^|&)(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '\\1', 'g'), '&+', '&', 'g'), '&'), ''), '') END AS n
  FROM p LEFT JOIN fit USING (page_id)),
said AS (SELECT n, CASE WHEN bool_or(own = 'allow') THEN 'allow' ELSE 'block' END AS d FROM node
         WHERE own IS NOT NULL AND n IS NOT NULL GROUP BY n)
SELECT page_id, host, path, rule, coalesce(own, d, 'allow') AS verdict, rule IS NULL AND d IS NOT NULL AS propagated
FROM node LEFT JOIN said USING (n)"""

_ORACLE_8 = r"""
WITH l AS (SELECT doc_id, source, i, line, trim(line, e' \t\r\x0b\x0c') = '' AS blank
           FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
pages AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE NOT blank GROUP BY ALL),
total AS (SELECT source, count(*) AS t FROM documents GROUP BY source),
bad AS (SELECT source, line FROM pages JOIN total USING (source) WHERE n >= 2 AND n > 0.06::DOUBLE * t),
kept AS (SELECT l.*, b.line IS NULL AS stays FROM l LEFT JOIN bad b ON b.source = l.source AND b.line = l.line),
out AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
               coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays), '') AS t FROM kept GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, length(t) AS n_chars, sha256(t) AS text_sha256 FROM out"""

_ORACLE_9 = """
WITH RECURSIVE link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.v)
SELECT v AS vec_id, (SELECT count(*) FROM link WHERE a = v) AS n_links, min(r) AS component_id, min(r) = v AS kept
FROM reach GROUP BY v"""

_ORACLE_11 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT doc_id, o, substr(h, 2 * o + 1, 298) AS h
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 100)) AS o FROM d WHERE length(h) >= 100)),
w AS MATERIALIZED (SELECT doc_id, o + p AS p, substr(h, 2 * p + 1, 100) AS s
      FROM (SELECT doc_id, o, h, unnest(range(least(100, length(h) // 2 - 49))) AS p FROM block)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE doc_id > m),
island AS (SELECT doc_id, p, sum(CASE WHEN p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS i
           FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), p) AS q FROM hit)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM island GROUP BY doc_id, i),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM span),
kept AS (SELECT doc_id, count(*) AS n, sum(b - a)::BIGINT AS r, max(b) AS z,
                string_agg(substr(h, (2 * e + 1)::BIGINT, (2 * (a - e))::BIGINT), '' ORDER BY a) AS k
         FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(k || substr(h, 2 * z + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

_ORACLE_12 = r"""
WITH term(t) AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
d AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, (SELECT t FROM term))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
q AS (SELECT item_id, translate(unnest(regexp_extract_all(text, (SELECT t FROM term))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, docs),
v AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // l))) AS v
      FROM tf JOIN n USING (doc_id) JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, sum(v)::BIGINT AS score FROM q JOIN v USING (term) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 20"""


def _tuned(fn: Callable) -> Callable:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _tuned(fn) for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_aliases": _ORACLE_1, "op8_site_lines": _ORACLE_8, "op9_pq_dedup": _ORACLE_9,
            "op11_suffix_dedup": _ORACLE_11, "op12_ball_tree": _ORACLE_12}
