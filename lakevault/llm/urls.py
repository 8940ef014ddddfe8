"""URL rules with redirect equivalence.

Rules (host, path) allow or block: a rule fits its host and all subdomains of it, if the url's path starts with the rule's
path; the longest rule wins. Urls that redirect to each other (meta refresh, or edges given) or name a canonical url are
aliases of one another: connected components over these edges are found distributed, and a block of any member reaches
all of them. A page's own rule takes precedence: an allow rule keeps a page that is an alias of a blocked one, and pages
that no rule and no blocked alias reach are allowed.

Links are read by an HTML parser (so that comments and scripts hold none, entities are decoded, and rel is a list of words)
and resolved as RFC 3986 says, against the page's base if it names one. The SQL knows plain relative links only.

Defined results: for a null url, or one without ``://``, host and path are empty and no rule fits; a fragment, or the case of
scheme and host, does not make another url; null html has no edges, nor have links that are no valid url; repeated urls
share a verdict; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakevault.llm.common import met, saved, table
from lakevault.llm.components import components

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The name of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("string")
    for rule_host, rule_path, _ in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((h == rule_host) | h.endswith(f".{rule_host}")) & p.startswith(rule_path)
        chosen = F.when(fits, F.lit(rule_host + rule_path)).otherwise(chosen)
    return chosen


def decision(rule: Column, rules: list[tuple[str, str, str]]) -> Column:
    blocks = [a + b for a, b, what in rules if what == "block"]
    return F.when(rule.isNull(), None).when(rule.isin(blocks), "block").otherwise("allow")


def key(url: Column) -> Column:
    """What makes two urls the same one: all but the fragment, the host in lower case."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    return F.concat(ascii_lower(F.regexp_extract(bare, r"(?s)^(.*?://)?", 1)), F.when(host(bare) != "", host(bare)).otherwise(""), F.when(bare.contains("://"), F.regexp_extract(bare, r"(?s)^.*?://[^/?]*(.*)$", 1)).otherwise(bare))


class Links(HTMLParser):
    """Canonical urls and refreshes of a page."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base, self.found = url, None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        has = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        to = ""
        if tag == "base" and self.base is None and has.get("href"):
            self.base = self.full(has["href"])
        elif tag == "link" and "canonical" in has.get("rel", "").lower().split():
            to = has.get("href", "").strip()
        elif tag == "meta" and has.get("http-equiv", "").strip().lower() == "refresh":
            to = (re.findall(r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)", has.get("content", "")) or [""])[0]
        if to and (to := self.full(to)):
            self.found.append(to)

    def full(self, to: str) -> str | None:
        try:
            return urljoin(self.base or self.url, to)
        except ValueError:
            return None


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Links(url)
            page.feed(html)
            page.close()
            rows += [(url, to) for to in page.found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["url", "go"])


def links(pages: DataFrame) -> DataFrame:
    """a, b: from each page's url to its canonical url and to where a refresh leads."""
    some = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")).select("url", "html")
    return some.mapInArrow(linked, "url string, go string").select(key(F.col("url")).alias("a"), key(F.col("go")).alias("b"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict; edges: more aliases, as two columns of urls."""
    found = links(pages)
    if edges is not None:
        found = found.unionByName(edges.select(key(F.col(edges.columns[0])).alias("a"), key(F.col(edges.columns[1])).alias("b")))
    found = saved(found.distinct(), "links")
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    own = own.withColumn("rule", ruled(F.col("host"), F.col("path"), rules))
    own = own.withColumn("own", decision(F.col("rule"), rules)).withColumn("key", key(F.col("url")))
    if found.isEmpty():
        return own.select("page_id", "url", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"))
    nodes = components(found, "string")
    blocked = F.max((decision(ruled(host(F.col("node")), path(F.col("node")), rules), rules) == "block").cast("int"))
    bad = nodes.groupBy("root").agg(F.coalesce(blocked, F.lit(0)).alias("bad"), F.count("*").alias("n")).where("bad = 1").select("root", "n")
    bad = met(nodes, bad, "root", "node", nodes.count()).select(F.col("node").alias("key"), F.lit("block").alias("alias"))
    judged = own.join(bad, "key", "left")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("own", "alias", F.lit("allow")).alias("verdict"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<((?:link|meta)\b[^>]*)>', 1)) AS tag FROM pages WHERE url IS NOT NULL),
goes AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)^link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS go FROM tags),
full_urls AS (SELECT split_part(url, '#', 1) AS a, split_part(CASE WHEN contains(go, '://') THEN go WHEN go LIKE '//%' THEN regexp_extract(url, '^([^:/?#]*:)', 1) || go
    WHEN go LIKE '/%' THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || go ELSE regexp_extract(url, '^([^?#]*)/', 1) || '/' || go END, '#', 1) AS b FROM goes WHERE go <> ''),
edges AS (SELECT a, b FROM full_urls UNION SELECT b, a FROM full_urls),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) t(h, s, what)),
nodes AS (SELECT a AS node FROM edges UNION SELECT b FROM edges),
node_rules AS (SELECT node, arg_max(what, length(h || s)) AS what FROM nodes, r
  WHERE (lower(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1)) = h OR ends_with(lower(regexp_extract(node, '(?s)^.*?://([^/?#]*)', 1)), '.' || h))
    AND starts_with(regexp_extract(node, '(?s)^.*?://[^/?#]*([^?#]*)', 1), s) GROUP BY node),
bad AS (SELECT node FROM node_rules WHERE what = 'block' UNION SELECT e.b FROM bad JOIN edges e ON e.a = bad.node),
fits AS (SELECT page_id, url, host, path, arg_max(h || s, length(h || s)) AS rule, arg_max(what, length(h || s)) AS what
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN split_part(url, '#', 1) IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits
"""
