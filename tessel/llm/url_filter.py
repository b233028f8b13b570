"""URL filters: rules first, then trust and distrust that spread over the host link graph.

Hosts with pages that an allow rule fits are trusted seeds; hosts that a block rule fits as a whole (path /) are blocked seeds. Trust spreads
along links (personalised PageRank); distrust spreads against them, from a blocked host to the hosts that link to it.
The PageRank of a host is the share of time that a walker spends there who starts at a random seed, follows links with probability DAMPING, and
else, or where a host has no links, starts anew. Summed over walks this is each host's expected visits per walk from one start at every seed,
divided by the sum over all hosts; so hosts without links need no step of their own. Rounds add up visits: they only grow, and end when all
that later rounds can add to all hosts together is below TOLERANCE, so no chain is too long.
A host whose distrust is above its trust, both in visits, and at least THRESHOLD is blocked; all others are allowed. Visits, not shares, are held
against the threshold, because shares shrink as seeds are added.
Links are host pairs, aggregated before any join; each round is one join and one aggregation, cut by a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, stored

#: Fixed values of the contract: (host/path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, THRESHOLD = 0.85, 0.1
#: What is left out of all scores together when rounds end, and the least share of their sum that can be told apart.
TOLERANCE, PRECISION = THRESHOLD / 1000, 1e-12
BROADCAST = 8 << 20
#: A link to an absolute or protocol-relative address; the group is its host.
LINK = r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or where there is no `://`."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: pages of src that link to dst, other hosts only. Null html has no links."""
    host, _ = host_and_path(F.col("url"))
    to = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower))
    pairs = pages.select(host.alias("src"), F.explode(to).alias("dst")).filter("src <> '' AND src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust and distrust (expected visits).

    edges: src, dst, links, stored; seeds: host, trusted, blocked (booleans). No seeds give no rows.

    Each round gives every host its seed plus damping times what its neighbours pass on, in proportion to links. A round adds at most damping times what
    the one before added, so later ones add at most damping / (1 - damping) times that.
    """
    both = [("trust", "src", "dst"), ("distrust", "dst", "src")]
    steps = None
    for kind, a, b in both:
        out = edges.groupBy(a).agg(F.sum("links").alias("_all")).withColumnRenamed(a, "_a")
        part = edges.join(out, F.col(a) == F.col("_a")).select(F.lit(kind).alias("kind"), F.col(a).alias("from"), F.col(b).alias("to"), (F.col("links") / F.col("_all")).alias("share"))
        steps = part if steps is None else steps.unionByName(part)
    start = seeds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("host"), F.col(c).cast("double").alias("score")) for k, c in (("trust", "trusted"), ("distrust", "blocked"))])).alias("s")).select("s.*").filter("score > 0")
    start = stored(start, "seeds")
    ranks = start
    if not edges.isEmpty():
        steps = stored(steps, "steps")
        added, total = 1.0, start.agg(F.sum("score")).first()[0] or 0.0
        while total and added * damping / (1 - damping) >= max(tolerance, PRECISION * total):
            moved = steps.join(ranks.withColumnRenamed("kind", "_k"), (F.col("kind") == F.col("_k")) & (F.col("from") == F.col("host")))
            moved = moved.select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            ranks = stored(moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score")), "ranks")
            before, total = total, ranks.agg(F.sum("score")).first()[0]
            added = total - before
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def page_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust_rank and distrust_rank: personalised PageRank, the share of all visits; each adds up to 1 where there is a seed."""
    visits = stored(propagate(edges, seeds, damping, tolerance), "visits")
    total = visits.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()  # two numbers
    return visits.select("host", *[(F.col(c) / (total[c] or 1.0)).alias(f"{c}_rank") for c in ("trust", "distrust")])


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every row.

    Null urls, and urls without `://`, have an empty host, which no rule and no link reaches: they are allowed. Repeated rows give a row
    each. Only page_id, url and html are read; no rows give no rows.
    """
    host, path = host_and_path(F.col("url"))
    rule, ruled = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), ruled.alias("_ruled"))
    whole = F.col("rule").isin([r for r, what in rules if what == "block" and r.endswith("/") and r.count("/") == 1])
    seeds = judged.filter("rule IS NOT NULL").groupBy("host").agg(F.max(F.col("_ruled") == "allow").alias("trusted"), F.max(whole).alias("blocked"))
    ranks = propagate(stored(host_edges(pages), "edges"), seeds)
    bad = stored(ranks.filter((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select(F.col("host").alias("_bad")), "blocked-hosts")
    out = judged.join(small(bad, BROADCAST), F.col("host") == F.col("_bad"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, html
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
edges AS (
  SELECT src, dst, count(*) AS links FROM (
    SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s<>]+)', 1), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM p)
  WHERE src <> '' AND src <> dst GROUP BY ALL),
steps AS (
  SELECT 'trust' AS kind, src AS a, dst AS b, links / sum(links) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM edges),
seeds AS (
  SELECT DISTINCT kind, host, 1.0::DOUBLE AS score FROM (
    SELECT CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'trust' WHEN rule = 'net/' THEN 'distrust' END AS kind, host FROM ruled) WHERE kind IS NOT NULL),
walk(i, kind, host, score) AS (
  SELECT 0, kind, host, score FROM seeds
  UNION ALL
  SELECT i + 1, kind, host, sum(score) FROM (
    SELECT w.i, w.kind, s.b AS host, 0.85 * w.score * s.share AS score FROM walk w JOIN steps s ON w.kind = s.kind AND w.host = s.a WHERE w.i < 150
  ) GROUP BY ALL),
ranks AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM walk GROUP BY host),
bad AS (SELECT host FROM ranks WHERE distrust >= 0.1 AND distrust > trust)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
