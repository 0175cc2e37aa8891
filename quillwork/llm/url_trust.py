"""URL filters: link-graph propagation of trust and distrust between hosts.

Rules of the form host/path-prefix judge the URLs that they fit. They also seed the hosts: a
host is trusted by the share of its pages that rules allow and distrusted by the share that
they block. Trust flows along the links as personalised PageRank, each host dealing its own out
among its links. Distrust flows against them from blocked hosts to those that link there, to each
by the share of its own links that lead there, so it doesn't thin out where many link to one. A
host is blocked when distrust is more than SHARE of both and at least FLOOR of what a wholly
blocked host starts with, so a few blocked pages or a few links don't condemn their host. Pages
without a rule take their host's verdict.

Steps go on until all flow that could still come is under TOLERANCE, for which there is a bound:
every step leaves at most DAMPING of the sum of trust and of the greatest distrust. Flow ends at
hosts without links. Each step joins the flow of the last step, one row per host, with the host edges and sums it
per target, so a hub is summed before the shuffle and a hub's edges may be split.

Defined results: a null URL or one without "://" has empty host and path, which no rule fits
and no link leads to, so it is allowed. Hosts without any flow are allowed; equal trust and
distrust allow. Loops are no edges; repeated links of a host pair weigh in by their count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm.common import ascii_lower, durable, table

#: (verdict, host/path-prefix)
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
DAMPING = 0.85
#: Flow that the steps may leave out.
TOLERANCE = 1e-7
SHARE = 0.5
FLOOR = 0.25
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'<>\s]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null without one.

    rules: a short list, as it becomes one expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): links between different hosts, by their count."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    found = found.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src != dst and src != '' and dst != ''")
    return found.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) for every host that any flow reaches.

    edges: (src, dst, links). seeds: (host, trusted, blocked), each weight 0 or more.
    Trust is the personalised PageRank of the trusted seeds up to a common factor. Distrust is
    that of the blocked seeds over reversed links, weighted at the linking host. What is left out
    of any host's trust or distrust is less than ``tolerance``.
    """
    shares = edges.join(edges.groupBy("src").agg(F.sum("links").alias("all_links")), "src").withColumn("part", F.lit(damping) * F.col("links") / F.col("all_links"))
    along, against = F.struct(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "part"), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "part")
    ways = durable(shares.select(F.explode(F.array(along, against)).alias("e")).select("e.*"))
    flow = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("trusted").alias("flow")), F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("flow")))).alias("s")).select("s.*")
    flow = durable(flow.where("flow > 0 and host is not null").groupBy("kind", "host").agg(F.sum("flow").alias("flow")))
    total = flow
    left = F.greatest(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("flow"))), F.lit(0.0)), F.coalesce(F.max(F.when(F.col("kind") == "distrust", F.col("flow"))), F.lit(0.0)))
    linked = not ways.isEmpty()
    while linked and flow.agg(left).first()[0] * damping / (1 - damping) >= tolerance:
        flow = durable(flow.join(ways, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("flow") * F.col("part")).alias("flow")))
        total = total.union(flow)
    both = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("flow"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")}
    return total.groupBy("host").agg(*both.values())


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, share: float = SHARE, floor: float = FLOOR) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for each of the pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    ruled = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    n = F.count("*")
    seeds = ruled.groupBy("host").agg((F.count_if(F.col("own.verdict") == "allow") / n).alias("trusted"), (F.count_if(F.col("own.verdict") == "block") / n).alias("blocked"))
    scores = propagate(host_edges(pages.select("url", "html")), seeds.where("host != ''"))
    joined = ruled.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    guilt = F.round(F.try_divide("distrust", F.col("trust") + F.col("distrust")), 6)
    fallback = F.when((guilt > share) & (F.round("distrust", 6) >= floor), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", fallback).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


def op1_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rule, name, prefix) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
  ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'),
  ('block', 'org/es/', 'org', '/es/')),
ruled AS (
  SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS own
  FROM p LEFT JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
  GROUP BY page_id, host, path),
links AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src|action)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''<>\s]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM p),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
ways AS (
  SELECT 'trust' AS kind, src AS host, dst AS target, 0.85::DOUBLE * links / sum(links) OVER (PARTITION BY src) AS part FROM edges
  UNION ALL SELECT 'distrust', dst, src, 0.85::DOUBLE * links / sum(links) OVER (PARTITION BY src) FROM edges),
seeds AS (
  SELECT host, count(*) FILTER (own = 'allow') / count(*)::DOUBLE AS trusted, count(*) FILTER (own = 'block') / count(*)::DOUBLE AS blocked
  FROM ruled WHERE host <> '' GROUP BY host),
walk(step, kind, host, flow) AS (
  SELECT 0, 'trust', host, trusted FROM seeds WHERE trusted > 0
  UNION ALL SELECT 0, 'distrust', host, blocked FROM seeds WHERE blocked > 0
  UNION ALL
  SELECT step + 1, walk.kind, target, sum(flow * part) FROM walk JOIN ways ON walk.kind = ways.kind AND walk.host = ways.host
  WHERE step < 140 GROUP BY step, walk.kind, target),
scores AS (
  SELECT host, coalesce(sum(flow) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(flow) FILTER (kind = 'distrust'), 0) AS distrust
  FROM walk GROUP BY host)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN round(distrust / nullif(trust + distrust, 0), 6) > 0.5 AND round(distrust, 6) >= 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 6) AS trust, round(coalesce(distrust, 0), 6) AS distrust
FROM ruled LEFT JOIN scores USING (host)
"""
