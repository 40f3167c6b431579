"""Verdicts on URLs: explicit rules, and block decisions carried over redirects and canonical links.

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the
rule's; the longest (host and path together) wins. URLs are equivalent if they differ only in scheme,
fragment, closing slashes or an index page, or if a chain of canonical links, refresh tags or given
redirects joins them. A query is part of the URL: spellings without it are joined by links alone. Every
canonical link and every refresh tag of a page counts; relative ones are resolved against the page's URL,
or its absolute ``<base>``. Where no rule fits a URL, it is blocked if any equivalent URL is blocked by a
rule, and allowed otherwise. An explicit allow rule always holds for the URLs that it fits, whatever
their aliases are.

A null URL, or one without ``://``, has an empty host and path, fits no rule and has no alias; null pages
have no links. Every row is returned, repeated rows as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepared, stored
from .components import connected_components

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REST = r"(?s)^.*?://(.*)$"
HOST = r"(?s)^([^/?#]*)"
PATH = r"(?s)^[^/?#]*([^?#]*)"
TAIL = r"(/index\.html?)?/*$"
QUERY = r"(?s)^[^?#]*\?([^#]*)"
#: Tags that may say where a page is found. A tag ends outside of quotes, or at the first > if quotes don't match.
_TAG = r"""(?is)<(?:{})\b(?:(?:[^>"']++|"[^"]*"|'[^']*'){{0,200}}+>|[^>]*>)"""
LINKING, BASE = _TAG.format("link|meta"), _TAG.format("base")
VALUE = r"""(?is)[\s"'/]{}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
#: Where a refresh tag's content points to, in quotes or not; else what follows url= anywhere in the tag.
REFRESH = r"""(?is)^\s*(?:[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)(?:"([^"]*)|'([^']*)|([^"'].*))"""
LOOSE = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"(?i)^[a-z][a-z0-9+.\-]*://"
SCHEME = r"(?i)^[a-z][a-z0-9+.\-]*:"


def _rest(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), REST, 1)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), PATH, 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null; rules is a short, fixed list."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
                        ).otherwise(chosen)
    return chosen


def node_of(url: Column) -> Column:
    """What equivalent spellings of a URL have in common; null for no URL."""
    query = F.regexp_extract(_rest(url), QUERY, 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.regexp_replace(path_of(url), TAIL, ""), F.when(
        query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _groups(text: Column, pattern: str) -> Column:
    """The one of three groups that matched, or null."""
    return F.nullif(F.trim(F.concat(*(F.regexp_extract(text, pattern, i) for i in (1, 2, 3)))), F.lit(""))


def _value(tag: Column, name: str) -> Column:
    return F.replace(_groups(tag, VALUE.format(name)), F.lit("&amp;"), F.lit("&"))


def _without_dots(path: Column) -> Column:
    """The path without its . and .. segments."""
    kept = F.aggregate(F.split(F.substring(path, 2, 1 << 30), "/"), F.array().cast("array<string>"), lambda done, x: (
        F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(x == ".", done).otherwise(F.concat(done, F.array(x)))))
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolved(raw: Column, url: Column) -> Column:
    """The URL that a link of the page ``url`` means; null: none, or no other page."""
    origin = F.when(host_of(url) != "", F.concat(F.lit("http://"), host_of(url)))
    path, query = F.regexp_extract(raw, r"(?s)^([^?#]*)", 1), F.regexp_extract(raw, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.regexp_extract(path_of(url), r"(?s)^(.*)/", 1), F.lit("/"))
    return (F.when((raw == "") | raw.startswith("#"), F.lit(None).cast("string"))
            .when(raw.rlike(ABSOLUTE), raw).when(raw.startswith("//"), F.concat(F.lit("http:"), raw))
            .when(raw.rlike(SCHEME), F.lit(None).cast("string"))
            .when(raw.startswith("/"), F.concat(origin, _without_dots(path), query))
            .when(raw.startswith("?"), F.concat(origin, path_of(url), raw))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query)))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) of every canonical link and refresh tag."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = _value(F.regexp_extract(html, BASE, 0), "href")
    tags = pages.select(F.col("url").alias("source"), F.when(base.rlike(ABSOLUTE), base).otherwise(F.col("url"))
                        .alias("base"), F.explode(F.regexp_extract_all(html, F.lit(LINKING), F.lit(0))).alias("tag"))
    tag, content = F.col("tag"), _value(F.col("tag"), "content")
    canonical = F.lower(F.substring(tag, 2, 4)) == "link"
    raw = (F.when(canonical & _value(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"), _value(tag, "href"))
           .when(~canonical & (F.lower(_value(tag, "http-equiv")) == "refresh"), F.coalesce(
               _groups(content, REFRESH), F.nullif(F.regexp_extract(tag, LOOSE, 1), F.lit("")))))
    found = tags.select("source", "base", raw.alias("raw")).where("raw IS NOT NULL")
    return found.select("source", resolved(F.col("raw"), F.col("base")).alias("target"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page.

    ``redirects`` (source, target) holds further redirect edges between URLs.
    """
    prepared(pages.sparkSession)
    found = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = found.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "node", node_of(F.col("url")))

    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    ends = links.where("target IS NOT NULL").select(
        node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"), *(f(F.col(c)).alias(f"{c}_{n}") for c in ("source", "target") for n, f in (("host", host_of), ("path", path_of))))
    edges = stored(ends.select(
        "a", "b", *(rule_of(F.col(f"{c}_host"), F.col(f"{c}_path"), rules)["verdict"].alias(f"{c}_verdict")
          for c in ("source", "target"))).distinct(), "url-links")

    seeds = reduce(DataFrame.union, [
        found.where(F.col("fit.verdict") == BLOCK).select("node"),
        *(edges.where(F.col(f"{c}_verdict") == BLOCK).select(F.col(n).alias("node"))
          for c, n in (("source", "a"), ("target", "b")))]).where("node IS NOT NULL").distinct()
    parts = stored(connected_components(edges, "a", "b", "url-parts"), "url-parts")
    spread = parts.join(parts.join(seeds, "node", "left_semi").select("component").distinct(), "component",
                        "left_semi").select("node")
    blocked = seeds.union(spread).distinct().withColumn("blocked", F.lit(True))
    # Pages that fit a rule ask for no alias, and neither do those without a host: they would all meet in one task.
    alone = found.where(F.col("fit").isNotNull() | F.col("node").isNull()).withColumn("blocked", F.lit(None).cast("boolean"))
    asked = found.where(F.col("fit").isNull() & F.col("node").isNotNull()).join(blocked, "node", "left")
    return alone.unionByName(asked).select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(
        F.col("fit.verdict"), F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"))
