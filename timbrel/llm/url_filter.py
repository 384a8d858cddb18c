"""URL filters with redirect equivalence.

A url is judged by the longest rule (host and its subdomains, path prefix) that fits. Urls that differ only in scheme,
fragment, tracking parameters or a trailing slash are one node; redirects (given, or ``http-equiv=refresh`` in a page)
and canonical links join nodes, and connected components of those edges are the aliases of a page. A url without a rule
takes its aliases' decision: allow if any alias is explicitly allowed, else block if any is blocked, else the default.

All is DataFrame expressions. Edges and decisions are counted by node before they are joined; a host or url that a third
of all pages share costs partial aggregates and a join that may be split.

Cases: a null url or one without ``://`` has an empty host and path, no rule, no node and the default verdict; null html
has no links; repeated pages are judged each; an empty table gives an empty result; other columns are ignored. A relative
link is resolved against its page's host and folder, with its ``.`` and ``..`` segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.llm.common import documents, materialize
from timbrel.llm.components import components

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _SMALL), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The form that all variants of a url share; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike("^(utm_[a-z]+|gclid|fbclid)=")), "&")
    whole = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host(url) != "", whole)


def _without_dots(url: Column) -> Column:
    """A url whose path has no segments ``.`` and ``..``."""
    parts = F.split(path(url), "/")
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    whole = F.concat(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0), F.array_join(kept, "/"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(path(url).contains("/."), whole).otherwise(url)


def _links(url: Column, html: Column) -> Column:
    """Absolute targets of a page's canonical and refresh links."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b")), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    base = F.concat(F.lit("http://"), host(url))
    folder = F.concat(base, F.regexp_extract(path(url), r"^(.*/)?", 0))

    def joined(x: Column) -> Column:
        return F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).when(x.startswith("/"), F.concat(base, x)).otherwise(F.concat(F.when(path(url) == "", F.concat(base, F.lit("/"))).otherwise(folder), x))

    def whole(x: Column) -> Column:
        return F.when(x.contains("://"), x).otherwise(_without_dots(joined(x)))

    found = F.transform(F.filter(F.concat(canonical, refresh), lambda x: x != ""), whole)
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), found).otherwise(F.array().cast("array<string>"))


def rule_of(where: Column, what: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, begin, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((where == at) | where.endswith("." + at)) & what.startswith(begin)
        best = F.when(fits, F.struct(F.lit(at + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url, html). ``redirects``: further edges
    (source, target) of urls. ``rules``: (host, path, verdict), a list of the size of a query plan."""
    url = F.col("url").cast("string")
    looked = pages.select("page_id", url.alias("url"), host(url).alias("host"), path(url).alias("path"), node(url).alias("node"), _links(url, F.col("html").cast("string")).alias("targets"))
    looked = materialize(looked.withColumn("best", rule_of(F.col("host"), F.col("path"), rules)), "pages")
    moves = looked.select(F.col("node").alias("a"), F.explode("targets").alias("target"))
    if redirects is not None:
        moves = moves.unionByName(redirects.select(node(F.col("source")).alias("a"), F.col("target").cast("string").alias("target")))
    edges = materialize(moves.select("a", "target", node(F.col("target")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "moves")
    ahead = edges.select(F.col("b").alias("node"), rule_of(host(F.col("target")), path(F.col("target")), rules).alias("best"))
    explicit = looked.select("node", "best").unionByName(ahead).filter("node IS NOT NULL AND best IS NOT NULL")
    said = explicit.groupBy("node").agg(F.max(F.col("best.verdict") == "allow").alias("allowed"), F.max(F.col("best.verdict") == "block").alias("blocked"))
    alias = components(edges, "a", "b").withColumnRenamed("node", "alias")
    own = said.join(alias, F.col("node") == F.col("alias"), "left").withColumn("component", F.coalesce("component", "node"))
    decided = own.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    decided = decided.select(F.col("component").alias("_component"), F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("decision"))
    # Only nodes with a page without a rule ask their aliases.
    asking = looked.filter("best IS NULL AND node IS NOT NULL").select("node").distinct().join(alias, F.col("node") == F.col("alias"), "left")
    answer = asking.select(F.col("node").alias("_node"), F.coalesce("component", "node").alias("c")).join(decided, F.col("c") == F.col("_component")).select("_node", "decision")
    out = looked.join(answer, F.col("node") == F.col("_node"), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "decision", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"), RULES)


def _sql_host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_SMALL}')"


def _sql_path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _sql_node(url: str) -> str:
    query = f"regexp_extract(coalesce({url}, ''), '(?s)^[^?#]*\\?([^#]*)', 1)"
    kept = f"array_to_string(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid)=')), '&')"
    return f"CASE WHEN {_sql_host(url)} <> '' THEN {_sql_host(url)} || regexp_replace({_sql_path(url)}, '/+$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


def _sql_rule(what: str, host: str, path: str) -> str:
    return f"(SELECT {what} FROM rules WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p) ORDER BY length(h || p) DESC LIMIT 1)"


#: Urls without a rule take the decision of their node's aliases; links are followed by recursion. Canonical and refresh
#: links of any quoting, over line ends and relative ones count, but for ``.`` and ``..`` segments of relative links.
OP6_SQL = rf"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {", ".join(map(str, RULES))}),
judged AS (SELECT *, {_sql_rule("h || p", "host", "path")} AS rule, {_sql_rule("v", "host", "path")} AS said
  FROM (SELECT page_id, url, html, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_node("url")} AS node FROM pages)),
tags AS (SELECT node, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM judged WHERE node IS NOT NULL),
links AS (SELECT node, host, path, CASE
    WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS x FROM tags),
targets AS (SELECT node AS a, CASE WHEN contains(x, '://') THEN x WHEN starts_with(x, '//') THEN 'http:' || x WHEN starts_with(x, '/') THEN 'http://' || host || x
    ELSE 'http://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)?') END || x END AS target FROM links WHERE x <> ''),
edges AS (SELECT DISTINCT a, target, {_sql_node("target")} AS b FROM targets),
both_ways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
explicit AS (SELECT node, said FROM judged WHERE node IS NOT NULL AND said IS NOT NULL
  UNION ALL SELECT b, {_sql_rule("v", "host", "path")} FROM (SELECT b, {_sql_host("target")} AS host, {_sql_path("target")} AS path FROM edges WHERE b IS NOT NULL)),
asking AS (SELECT DISTINCT node FROM judged WHERE node IS NOT NULL AND rule IS NULL),
reach(a, b) AS (SELECT node, node FROM asking UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
decided AS (SELECT r.a AS node, bool_or(x.said = 'allow') AS allowed, bool_or(x.said = 'block') AS blocked FROM reach r JOIN explicit x ON x.node = r.b AND x.said IS NOT NULL GROUP BY r.a)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN decided USING (node)
"""
