"""Judging urls by rules, and where no rule fits by trust spread over the link graph of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from braidset.session import discard, materialize

#: Share of the seeds' mass that may be left where the walk ends.
TOLERANCE = 1e-6
#: (verdict, host and path): a rule holds for its host and all subdomains, where the path starts with the rule's.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): how many absolute links of pages of one host lead to another host."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    counted = links.select(F.col("host").alias("src"), host_of(full).alias("dst")).where(
        "src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("links"))
    return materialize(counted, "host-links")


def _spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank (host, mass) of ``seeds`` (host, seed) along edges (a, b, share).

    Mass stays in pages: 1 / (1 - damping) times the usual share. A step passes on what the step before brought to each host; it ends
    where nothing is left to pass on, or less than ``tolerance`` of the seeds' mass, which damping bounds at
    log(tolerance) / log(damping) steps.
    """
    parts = [seeds.select("host", F.col("seed").alias("mass"))]
    total = parts[0].agg(F.sum("mass").alias("s")).first()["s"] or 0.0
    while total:
        moved = parts[-1].join(edges, F.col("host") == F.col("a")).groupBy(F.col("b").alias("host"))
        parts.append(materialize(moved.agg((F.lit(damping) * F.sum(F.col("mass") * F.col("share"))).alias("mass")), "mass"))
        if (parts[-1].agg(F.sum("mass").alias("s")).first()["s"] or 0.0) < tolerance * total:
            break
    whole = materialize(reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
    discard(*parts)
    return whole


def judge_hosts(pages: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE, limit: float = 0.25) -> DataFrame:
    """(host, host_verdict) for the hosts of ``pages`` (host, path, html, hit).

    Trust starts at hosts with pages that a rule allows and follows links forward; distrust starts at
    hosts with pages that a rule blocks and follows links backward, from a page to those
    that link to it. Seeds weigh as many as their pages. Both are personalised PageRank over shares
    of links, up to ``tolerance`` of the seeds' mass. A host is blocked where distrust less trust reaches ``limit`` of its pages.
    """
    hosts = materialize(pages.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.sum(F.when(F.col("hit.verdict") == "allow", 1.0).otherwise(0.0)).alias("trusted"),
        F.sum(F.when(F.col("hit.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
    ), "hosts")
    links = host_edges(pages)
    out = links.groupBy("src").agg(F.sum("links").alias("n"))
    forward = materialize(links.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("links") / F.col("n")).alias("share")), "forward")
    into = links.groupBy("dst").agg(F.sum("links").alias("n"))
    backward = materialize(links.join(into, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("links") / F.col("n")).alias("share")), "backward")
    trust = _spread(forward, hosts.where("trusted > 0").select("host", F.col("trusted").alias("seed")), damping, tolerance)
    distrust = _spread(backward, hosts.where("blocked > 0").select("host", F.col("blocked").alias("seed")), damping, tolerance)
    judged = hosts.join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
    worse = F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) >= limit * F.col("pages")
    return judged.select("host", F.when(worse, "block").otherwise("allow").alias("host_verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, tolerance: float = TOLERANCE, limit: float = 0.25) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; see ``judge_hosts`` for pages without a rule.

    A null url or one without ``://`` has an empty host and path; such pages are a host of their own that
    has no links, so they are allowed. A null html has no links. Repeated rows are judged alike and counted
    each. An empty table gives no rows. Other columns are ignored.
    """
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    cut = cut.withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    hosts = materialize(judge_hosts(cut, damping, tolerance, limit), "host-verdicts")
    return cut.join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("host_verdict"), F.lit("allow")).alias("verdict"),
    )


#: 0.85 to the power of 86 is below the tolerance.
URL_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hit AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM cut),
ruled AS (SELECT *, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given FROM hit),
hosts AS (SELECT host, count(*) AS pages, count(*) FILTER (WHERE given = 'allow') AS trusted, count(*) FILTER (WHERE given = 'block') AS blocked FROM ruled GROUP BY host),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]+)', 1)) AS link FROM cut),
counted AS (SELECT src, dst, count(*) AS links FROM (SELECT src,
    translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM links)
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
edges AS (SELECT 't' AS kind, src AS a, dst AS b, links / sum(links) OVER (PARTITION BY src) AS share FROM counted
  UNION ALL SELECT 'd', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM counted),
seeds AS (SELECT 't' AS kind, host, CAST(trusted AS DOUBLE) AS seed FROM hosts WHERE trusted > 0
  UNION ALL SELECT 'd', host, CAST(blocked AS DOUBLE) FROM hosts WHERE blocked > 0),
walk AS (SELECT 0 AS step, kind, host, seed AS mass FROM seeds
  UNION ALL SELECT w.step + 1, w.kind, e.b, 0.85::DOUBLE * sum(w.mass * e.share) FROM walk w JOIN edges e ON e.kind = w.kind AND e.a = w.host WHERE w.step < 86 GROUP BY w.step, w.kind, e.b),
mass AS (SELECT kind, host, sum(mass) AS mass FROM walk GROUP BY kind, host),
judged AS (SELECT h.host, CASE WHEN coalesce(d.mass, 0) - coalesce(t.mass, 0) >= 0.25 * h.pages THEN 'block' ELSE 'allow' END AS verdict FROM hosts h
  LEFT JOIN mass t ON t.kind = 't' AND t.host = h.host LEFT JOIN mass d ON d.kind = 'd' AND d.host = h.host)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.given, j.verdict) AS verdict FROM ruled r JOIN judged j USING (host)
"""
