"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

Personalised PageRank runs from trusted hosts along links, and from blocked hosts against them: a host that
links to blocked hosts earns distrust. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, written

#: (host, path, verdict); a rule fits its host, all subdomains, and paths that start with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link with a host of its own: the value of href or src that begins with a scheme and //, or with // alone.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.lit(""))
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equal ones the first), as host and path, or null."""
    found = F.lit(None).cast("string")
    for h, p, _ in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def verdict_of(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for h, p, v in rules:
        out = F.when(rule == h + p, F.lit(v)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(a, b, weight): how many links pages of host a hold to another host b."""
    host, _ = host_and_path(F.col("url"))
    named = pages.select(host.alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("b")).select("a", ascii_lower(F.col("b")).alias("b"))
    return named.where("a <> '' and a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 10) -> DataFrame:
    """(host, score) after so many rounds over (a, b, weight) from seeds (host, weight).

    Seeds' shares add up to 1. What a host without outgoing links holds is lost, not spread: scores are compared,
    never summed. Every fifth round is written to the shared folder.
    """
    seeds = seeds.where("weight > 0")
    total = seeds.agg(F.sum("weight").alias("total"))  # one row
    start = written(seeds.join(F.broadcast(total)).select("host", (F.col("weight") / F.col("total")).alias("seed")), "rank-seeds")
    if edges.isEmpty() or start.isEmpty():
        return start.select("host", ((1 - damping) * F.col("seed")).alias("score"))
    out = edges.groupBy("a").agg(F.sum("weight").alias("all"))
    steps = written(edges.join(out, "a").select("a", "b", (F.col("weight") / F.col("all")).alias("share")), "rank-steps")
    score = start.withColumnRenamed("seed", "score")
    for k in range(rounds):
        passed = steps.join(score.withColumnRenamed("host", "a"), "a").select(F.col("b").alias("host"), (damping * F.col("score") * F.col("share")).alias("x"))
        score = passed.union(start.select("host", ((1 - damping) * F.col("seed")).alias("x"))).groupBy("host").agg(F.sum("x").alias("score"))
        if k % 5 == 4 or k == rounds - 1:
            score = written(score, "rank")
    return score


def judged(pages: DataFrame, rules=RULES, ratio: float = 1.0, links: DataFrame | None = None) -> DataFrame:
    """One row a page (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Trusted seeds are hosts with pages that a rule allows, blocked seeds hosts with pages that a rule for
    whole hosts blocks, each by its number of such pages. A page without a rule is blocked when its host's distrust
    is above ``ratio`` times its trust, and allowed otherwise. A null url, or one without ``://``, has an empty host and path
    and is allowed; null html has no links; repeated rows are judged alike; no pages give no rows.
    ``links`` (a, b, weight) may replace the links found in the pages.
    """
    host, path = host_and_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("given", verdict_of(F.col("rule"), rules))
    edges = written(host_links(pages) if links is None else links.select("a", "b", "weight"), "host-links")
    whole = [h + p for h, p, v in rules if v == "block" and p == "/"]
    counts = written(seen.where("rule is not null").groupBy("host").agg(F.count_if(F.col("given") == "allow").alias("good"), F.count_if(F.col("rule").isin(whole)).alias("bad")), "host-seeds")
    trust = personalised_rank(edges, counts.select("host", F.col("good").alias("weight"))).withColumnRenamed("score", "trust")
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")
    distrust = personalised_rank(back, counts.select("host", F.col("bad").alias("weight"))).withColumnRenamed("score", "distrust")
    scores = written(trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "host-scores")
    joined = seen.join(if_small(scores), "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "trust", "distrust")


def oracle_sql(rounds: int = 10) -> str:
    """The verdicts in SQL, with the rounds written out as one query each."""
    def rank(name: str, edges: str, seeds: str) -> str:
        out = [f"{name}_s AS (SELECT host, CAST(w AS DOUBLE) / sum(w) OVER () AS x FROM {seeds} WHERE w > 0), {name}0 AS MATERIALIZED (SELECT host, x FROM {name}_s)"]
        for k in range(rounds):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT host, sum(x) AS x FROM (SELECT e.b AS host, 0.85 * s.x * e.w / e.total AS x FROM {edges} e JOIN {name}{k} s ON s.host = e.a UNION ALL SELECT host, 0.15 * x FROM {name}_s) GROUP BY host)")
        return ", ".join(out)

    return rf"""
WITH raw AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS path FROM raw),
s AS (SELECT *, CASE
   WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
   WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
   WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM u),
l AS (SELECT host AS a, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s>]+)', 1)), '{UPPER}', '{LOWER}') AS b FROM s),
e1 AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS w, sum(count(*)) OVER (PARTITION BY a) AS total FROM l WHERE a <> '' AND a <> b GROUP BY a, b),
e2 AS (SELECT b AS a, a AS b, w, sum(w) OVER (PARTITION BY b) AS total FROM e1),
good AS (SELECT host, count(*) AS w FROM s WHERE rule IN ('example.net/en/', 'org/fr/') GROUP BY host),
bad AS (SELECT host, count(*) AS w FROM s WHERE rule = 'net/' GROUP BY host),
{rank("t", "e1", "good")},
{rank("d", "e2", "bad")}
SELECT s.page_id, s.host, s.path, s.rule,
       CASE WHEN s.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN s.rule IS NOT NULL THEN 'block'
            WHEN coalesce(d{rounds}.x, 0) > coalesce(t{rounds}.x, 0) THEN 'block' ELSE 'allow' END AS verdict,
       round(coalesce(t{rounds}.x, 0), 9) AS trust, round(coalesce(d{rounds}.x, 0), 9) AS distrust
FROM s LEFT JOIN t{rounds} ON t{rounds}.host = s.host LEFT JOIN d{rounds} ON d{rounds}.host = s.host
"""
