"""Operator 8: URL filters with redirect equivalence.

A URL is judged by the longest rule that fits its host and path. A few rules become one CASE; more of them, however
many, are a table, which distinct hosts and paths are joined with by the texts of the rules that could fit them. URLs that
no rule fits take the judgement of their aliases: the pages that a canonical link or a redirect ties together, directly or
through others, form a component, of the URLs' own texts; a
component with a blocked member and no allowed one blocks its members without a rule. An allow rule goes before: it
holds for its own URL whatever the aliases are, and it lifts what a component would pass on.

Only URLs and extracted links are shuffled, never pages. Results: a null URL, or one without "://", has an empty host
and path, fits no rule and has no aliases; rows that repeat are judged each; null pages have no links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm import columns
from inkstream.llm.components import components
from inkstream.session import discard, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
#: Rules that one CASE holds, at most; more are looked up by a join.
INLINE_RULES = 100


@dataclass(frozen=True)
class Rule:
    """``verdict`` ("allow" or "block") for a host and its subdomains, where the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


def host(url: str | Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_text(url), _PARTS, 1), _UPPER, _LOWER)


def path(url: str | Column) -> Column:
    """After the host up to "?", "#" or the end."""
    return F.regexp_extract(_text(url), _PARTS, 2)


def _text(url: str | Column) -> Column:
    return F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))


def ordered(rules: list[Rule]) -> list[Rule]:
    """Longest first; of equally long ones, allow first."""
    return sorted(rules, key=lambda r: (-len(r.text), r.verdict, r.text))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def node(url: Column) -> Column:
    """The resource that a URL names: host, path and query, without scheme and fragment."""
    return F.concat(host(url), path(url), F.regexp_extract(url, _PARTS, 3))


def links(pages: DataFrame) -> DataFrame:
    """Rows (url, target): canonical links and immediate redirects of pages, as absolute URLs."""
    canonical = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*\d*\s*;?\s*url\s*=\s*["']?([^"'\s>]+)"""
    found = F.array(*[F.regexp_extract("html", p, 1) for p in (canonical, refresh)])
    rows = pages.where(F.col("url").contains("://") & F.col("html").isNotNull()).where(F.col("html").rlike("(?i)canonical|refresh"))
    rows = rows.select("url", F.explode(F.filter(found, lambda x: x != "")).alias("to"))
    origin, folder = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0), F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*/)?", 0)
    to = F.replace("to", F.lit("&amp;"), F.lit("&"))
    target = F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.regexp_extract("url", "(?s)^.*?:", 0), to)).when(to.startswith("/"), F.concat(origin, to)).when(folder == origin, F.concat(origin, F.lit("/"), to)).otherwise(F.concat(folder, to))
    return rows.select("url", target.alias("target"))


def ruled(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (with host and path) with the rule that fits best and its verdict; null if none does."""
    none = F.lit(None).cast("string")
    if not rules:
        return rows.withColumns({"rule": none, "verdict": none})
    if len(rules) <= INLINE_RULES:
        rule = verdict = F
        for r in ordered(rules):
            fit = fits(r, F.col("host"), F.col("path"))
            rule, verdict = rule.when(fit, r.text), verdict.when(fit, r.verdict)
        return rows.withColumns({"rule": rule, "verdict": verdict})
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.text, r.verdict) for r in rules], "rule string, verdict string").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})  # how many labels and characters a rule can have
    tries = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
    pairs = rows.select("host", "path").distinct().select("host", "path", F.explode(tries).alias("t"))
    pairs = pairs.where((F.length("path") >= F.col("t.chars")) & (F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1 >= F.col("t.labels")))
    pairs = pairs.select("host", "path", F.concat(F.expr("substring_index(host, '.', -t.labels)"), F.expr("substring(path, 1, t.chars)")).alias("rule"))
    best = pairs.join(table, "rule").groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct(-F.length("rule"), "verdict", "rule")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(*rows.columns, "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """Columns page_id, host, path, rule (null if none fits), verdict; one row for each row of ``pages``.

    ``redirects`` may add edges that no page shows, such as HTTP redirects: columns url, target.
    """
    pages = columns.plain(pages, "page_id", "url", "html")
    rows = ruled(pages.select("page_id", "url", host("url").alias("host"), path("url").alias("path")), rules)
    edges = links(pages) if redirects is None else links(pages).union(redirects.select("url", "target").where(F.col("url").contains("://") & F.col("target").contains("://")))
    edges = materialise(edges.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")).where("a <> b").distinct(), "links")
    if edges.isEmpty():
        discard(edges)
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    sets = materialise(components(edges), "aliases")
    member = rows.where(F.col("url").contains("://")).select(node(F.col("url")).alias("node"), "verdict")
    marked = sets.join(member.where("verdict IS NOT NULL"), "node").groupBy("component").agg(F.bool_or(F.col("verdict") == "block").alias("blocked"), F.bool_or(F.col("verdict") == "allow").alias("allowed"))
    passed = sets.join(marked.where("blocked AND NOT allowed"), "component").select("node", F.lit("block").alias("passed"))
    rows = rows.withColumn("node", F.when(F.col("verdict").isNull() & F.col("url").contains("://"), node(F.col("url"))))
    return rows.join(passed, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", "passed", F.lit("allow")).alias("verdict"))


#: The rules of the query.
RULES = [Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/")]

#: The query for DuckDB; RE2 has no lookahead, so links are found by two patterns, one for either order of attributes.
SQL = r"""
WITH RECURSIVE parts AS (
  SELECT page_id, html, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
keyed AS (
  SELECT *, regexp_replace(regexp_replace(url, '(?s)#.*$', ''), '(?s)^.*?://', '') AS node,
    CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own
  FROM judged),
targets AS (
  SELECT node, unnest(list_filter([
    regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*url\s*=\s*["'']?([^"''\s>]+)', 1)], lambda x: x <> '')) AS target
  FROM keyed WHERE html IS NOT NULL),
edges AS (SELECT node AS a, regexp_replace(regexp_replace(replace(target, '&amp;', '&'), '(?s)#.*$', ''), '(?s)^.*?://', '') AS b FROM targets WHERE target LIKE '%://%'),
ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
passed AS (
  SELECT r.a AS node FROM reach r JOIN keyed k ON k.node = r.b WHERE k.own IS NOT NULL
  GROUP BY r.a HAVING bool_or(k.own = 'block') AND NOT bool_or(k.own = 'allow'))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN p.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM keyed k LEFT JOIN passed p ON p.node = k.node
"""
