"""URL filter with redirect equivalence: rules judge URLs, and block decisions reach their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..functions.urls import resolve_url
from ..session import small_side, written
from .common import ascii_lower, components

# (action, host, path) of the production rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Query parameters that never change the page.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` (A-Z lower-cased) and path up to ``?`` or ``#``; both '' without ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    host = F.when(known, ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")
    path = F.when(known, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_struct(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, allow before block on equal length; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    fit = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in reversed(ordered):
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        fit = F.when(on_host & path.startswith(rule_path),
                     F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(fit)
    return fit


def canonical_form(url: Column) -> Column:
    """The form aliases share: no fragment, no tracking parameters, one scheme, no slash or index file at the end."""
    host, path = host_and_path(url)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.html?\z", ""), r"/+\z", "")
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), rf"(^|&){TRACKING}=[^&]*", "$1")
    query = F.regexp_replace(F.regexp_replace(query, "&+", "&"), r"^&|&\z", "")
    form = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.contains("://"), form)


def stated_targets(html: Column) -> Column:
    """What a page names as its own URLs, as it stands there: every refresh redirect and every canonical link."""
    some = F.lower(html).contains("refresh") | F.lower(html).contains("canonical")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:meta|link)\s[^>]*>"), F.lit(0))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\s.*\bhttp-equiv\s*=\s*["']?refresh\b""")), lambda t: F.regexp_extract(
        t, r"""(?is)(?<![\w-])content\s*=.*?(?<![\w-])url\s*=\s*["']?([^"'\s>]+)""", 1))
    link = F.transform(F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\s.*\brel\s*=\s*["']?canonical\b""")), lambda t: F.regexp_extract(
        t, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.when(some, F.array_distinct(F.filter(F.concat(refresh, link), lambda t: t != "")))


def url_edges(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of pages that redirect or state a canonical URL, a row for each absolute target."""
    return (pages.filter(F.col("url").isNotNull() & F.col("html").isNotNull())
            .select("url", F.explode(once(stated_targets(F.col("html")))).alias("_stated"))
            .select("url", resolve_url(F.col("url"), F.col("_stated")).alias("target")).filter("target is not null"))


def _url_node(url: Column) -> Column:
    return F.when(url.contains("://"), F.concat(F.lit("u"), url))


def alias_edges(urls: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` between nodes: every URL and its canonical form, every URL and each of its targets.

    Nodes are texts, 'u' and a URL or 'f' and a form, so that no form is taken for a URL.
    """
    all_urls = urls.select("url").union(edges.select("url")).union(edges.select("target"))
    forms = all_urls.select(_url_node(F.col("url")).alias("a"), F.concat(F.lit("f"), canonical_form(F.col("url"))).alias("b"))
    stated = edges.select(_url_node(F.col("url")).alias("a"), _url_node(F.col("target")).alias("b"))
    return forms.union(stated).filter("a is not null and b is not null").distinct()


def judge_urls(urls: DataFrame, edges: DataFrame, rules=RULES, key: str = "page_id") -> DataFrame:
    """``(key, host, path, rule, verdict, propagated)`` for every row of ``urls`` (columns ``key`` and ``url``).

    A URL with a rule gets that rule's verdict. All others get the decision of their redirect class, a connected
    component over the edges between URLs and their canonical forms and over ``edges (url, target)``; a class with an
    allowed member is allowed, else one with a blocked member is blocked, else allowed. Targets count as members even where
    they are no row themselves. Null URLs and URLs without ``://`` have empty host and path, no rule and no
    alias: allowed. Repeated rows are judged alike and all returned; empty tables give an empty result;
    further columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    known = urls.select(F.col(key).alias("_key"), "url", host.alias("host"), path.alias("path"))
    known = written(known.withColumn("fit", rule_struct(F.col("host"), F.col("path"), rules)), "judged")
    edges = written(edges.select("url", "target"), "stated")  # long expressions end here
    classes = components(written(alias_edges(known, edges), "alias_edges"))
    root = small_side(classes.select(F.col("id").alias("node"), F.col("component").alias("root")), "classes")
    known = known.withColumn("node", _url_node(F.col("url"))).drop("url")
    t_host, t_path = host_and_path(F.col("target"))
    targets = edges.select(_url_node(F.col("target")).alias("node"), rule_struct(t_host, t_path, rules).action.alias("action"))
    # The members' own decisions, a row per URL before they meet in their class.
    said = (known.select("node", F.col("fit.action").alias("action")).union(targets)
            .filter("node is not null and action is not null").distinct())
    decided = (said.join(root, "node").groupBy("root")
               .agg(F.when(F.bool_or(F.col("action") == "allow"), "allow").otherwise("block").alias("decision")))
    decided = small_side(decided, "decided")
    return (known.join(root, "node", "left").join(decided, "root", "left")
            .select(F.col("_key").alias(key), "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.action", "decision", F.lit("allow")).alias("verdict"),
                    (F.col("fit").isNull() & F.col("decision").isNotNull()).alias("propagated")))
