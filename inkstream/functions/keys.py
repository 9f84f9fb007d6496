"""Hashes, fingerprints and URL functions."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstream.functions import lists
from inkstream.functions.text import c, truncate


def short_hash(x: str) -> Column:
    """multiply-by-33 hash over characters, folded to a signed 32-bit integer, its magnitude in base 36.

    Characters beyond the basic plane count once here, by code point.
    """
    h = f"aggregate(filter(split({x}, ''), c -> c <> ''), 5381L, (h, c) -> (h * 33 + ascii(c)) & 4294967295L)"
    return F.expr(f"lower(conv(cast(abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) AS string), 10, 36))")


def md5_short(x: str | Column) -> Column:
    """the first nine hexadecimal digits of the MD5, in base 36."""
    return F.lower(F.conv(F.substring(F.md5(c(x)), 1, 9), 16, 36))


def sha_short(x: str | Column) -> Column:
    """F03."""
    return F.substring(F.sha2(c(x), 256), 1, 16)


def candidates_fingerprint(url: str, title: str, date: str, snippet: str) -> Column:
    """F04, an aggregate: hash of a set of candidates in order of url."""
    row = F.struct(F.col(url).alias("url"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(date, F.lit("")).alias("date"), truncate(F.coalesce(snippet, F.lit("")), 350, 347, "...").alias("snippet"))
    return F.substring(F.md5(F.to_json(F.array_sort(F.collect_list(row)))), 1, 12)


def urls_fingerprint(url: str) -> Column:
    """F05, an aggregate: hash of a list of urls in order."""
    return F.substring(F.md5(F.to_json(F.array_sort(F.collect_list(url)))), 1, 12)


def cover_key(week: Column, titles: Column, variant: Column) -> Column:
    """hash of the week, the sorted titles and the variant."""
    return F.sha2(F.concat_ws("|", week, F.array_join(F.array_sort(titles), "|"), variant), 256)


def canonical(url: str | Column) -> Column:
    """scheme, lower-case host without port, path less one slash at its end, query; no fragment."""
    u = c(url)
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]+)(:[0-9]+)?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(u, pattern, k)
    return F.when(u.rlike(pattern), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(4), "/$", ""), part(5))).otherwise(u)


def host(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def without_www(host: Column) -> Column:
    """the first "www." is dropped, wherever it stands."""
    at = F.locate("www.", host)
    return F.when(at > 0, F.concat(F.substring(host, F.lit(1), at - 1), F.substring(host, at + 4, F.length(host)))).otherwise(host)


def is_consultancy(domain: Column, domains: list[str] | None = None) -> Column:
    """one of the domains or below it."""
    d = without_www(F.lower(domain))
    out = F.lit(False)
    for x in lists.CONSULTANCIES if domains is None else domains:
        out = out | (d == x) | d.endswith("." + x)
    return out


def is_platform(domain: Column, domains: list[str] | None = None) -> Column:
    """some domain is part of it."""
    d = without_www(F.lower(domain))
    out = F.lit(False)
    for x in lists.PLATFORMS if domains is None else domains:
        out = out | d.contains(x)
    return out


def site_of(query: str | Column) -> Column:
    """what a ``site:`` operator asks for; null without one."""
    return F.nullif(F.regexp_extract(c(query), r"site:([^\s]+)", 1), F.lit(""))


def without_site(query: str | Column) -> Column:
    """the query without ``site:`` operators."""
    return F.trim(F.regexp_replace(c(query), r"site:[^\s]+\s*", ""))


def source_type(domain: Column) -> Column:
    """C05."""
    return F.when(is_consultancy(domain), "consultancy").when(is_platform(domain), "platform").otherwise("discovery")


def pattern_any(patterns: list[str]) -> str:
    """One alternation of patterns that ignores case."""
    return "(?i)" + "|".join(patterns)


