"""Verdicts on page urls: rules by host and path, and link-graph propagation for what no rule decides; DataFrame functions only.

Hosts are the vertices. Edges are the links in the pages' html from one host to another, and an edge either way between a host and its
parent domain. Trust is a personalised PageRank whose seeds are the pages that rules allow; distrust is the same against the direction of the
edges, from the pages that rules block: who links to the blocked is distrusted. The blocked share of a host's surroundings is a walk against
the edges that starts at hosts in proportion to their blocked share of pages, over the same walk from every host with pages: it exists
without any trust, 0 where nothing is blocked and 1 where everything is. A host whose distrust exceeds `limit` times its trust and whose
share exceeds `least` is blocked, other hosts are allowed: about half of a host's own pages blocked, or of the hosts' beside it.

Only hosts, edges summed by host pair, and rules are joined with each other. Pages, without their html, are joined with their host's row; a
host with many pages, or the empty host, is spread over tasks. Walks take as many rounds as leave TOLERANCE of their weight unsettled.

Defined results: a null url, or one without `://`, has empty host and path and is allowed; hosts without pages take part in the graph but
are not reported; a host of more than 253 characters, which no name has, is judged by rules and pages, but has no edge to a parent domain; rows with equal page_id are judged one by one; equal rules count once, and of equally long ones a block wins; without
rules every page is allowed; a null or empty html has no links, and one of any length is searched whole; an empty table gives an empty
result; other columns, also of the names of results, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import cut, materialise, spread_join

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, ROUNDS_A_CUT = 0.7, 1e-3, 5
#: After k rounds exactly DAMPING ** k of a walk's weight at most is still on its way, on any graph.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
LIMIT = 2.0
#: A walk ends at its own host with about half of its weight: half of the pages of a host blocked, and none beside it, reach this share.
LEAST = 0.25
#: Characters of a domain name at most.
NAME = 253


@dataclass(frozen=True)
class UrlRule:
    """Fits `host` and its subdomains, for paths that begin with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _suffixes(host: Column, most: int) -> Column:
    """The host and each domain above it, of at most `most` labels."""
    labels = F.split(host, r"\.")
    ends = F.slice(labels, -F.least(F.size(labels), F.lit(most)), F.lit(most))
    return F.transform(F.sequence(F.lit(1), F.size(ends)), lambda i: F.array_join(F.slice(ends, i, F.size(ends) - i + 1), "."))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of host src that link to host dst, from (host, html)."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), 1), lambda x: url_host(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))))
    return pages.select(F.col("host").alias("src"), F.explode(targets).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight 1) between each host and its parent domain, either way; the last label alone is no parent, a host too long for a name has none."""
    named = hosts.where(F.length("host") <= NAME)
    up = named.select(F.explode(F.filter(_suffixes(F.col("host"), NAME), lambda x: x.contains("."))).alias("src")).distinct()
    up = up.withColumn("dst", F.regexp_replace("src", r"^[^.]*\.", "")).where(F.col("dst").contains("."))
    return up.select("src", "dst", F.lit(1.0).alias("weight")).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("weight")))


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust, share) from edges (src, dst, weight) and seeds (host, trusted, blocked, and pages if share is wanted), weights of any scale."""
    ways = edges.select(F.lit(True).alias("good"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(edges.select(F.lit(False).alias("good"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    ways = ways.groupBy("good", "a", "b").agg(F.sum("weight").alias("weight"))
    out = ways.groupBy("good", "a").agg(F.sum("weight").alias("out"))
    ways = cut(ways.join(out, ["good", "a"]).select("good", "a", "b", (F.col("weight") / F.col("out")).alias("part")))
    total = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("d"))
    pages = F.col("pages") if "pages" in seeds.columns else F.lit(None).cast("double")
    # walk: trust, distrust, blocked shares, every host
    walks = ((True, F.try_divide("trusted", "t")), (False, F.try_divide("blocked", "d")), (False, F.try_divide("blocked", pages)), (False, F.when(pages > 0, 1.0)))
    start = seeds.join(F.broadcast(total)).select("host", F.explode(F.array(*(F.struct(F.lit(k).alias("walk"), F.lit(good).alias("good"), seed.cast("double").alias("seed")) for k, (good, seed) in enumerate(walks)))).alias("x"))
    start = cut(start.select("host", "x.walk", "x.good", "x.seed").where("seed > 0"))
    base = start.select("host", "walk", "good", (F.col("seed") * (1 - DAMPING)).alias("score"))
    score = base
    for k in range(ROUNDS):
        moved = ways.join(score.withColumnRenamed("host", "a"), ["good", "a"]).select(F.col("b").alias("host"), "walk", "good", (F.col("score") * F.col("part") * DAMPING).alias("score"))
        score = moved.unionByName(base).groupBy("host", "walk", "good").agg(F.sum("score").alias("score"))
        if k % ROUNDS_A_CUT == ROUNDS_A_CUT - 1:
            score = cut(score)
    of = lambda k: F.sum(F.when(F.col("walk") == k, F.col("score")).otherwise(0.0))
    return score.groupBy("host").agg(of(0).alias("trust"), of(1).alias("distrust"), F.coalesce(F.try_divide(of(2), of(3)), F.lit(0.0)).alias("share"))


def judged_urls(pages: DataFrame, rules: Sequence[UrlRule], limit: float = LIMIT, least: float = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust, share) for each row of `pages` (page_id, url, html)."""
    spark = pages.sparkSession
    thin = materialise(pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")), "urls")
    # the rules are a list of the caller, not data that grows
    literal = [F.struct(F.lit(r.host).alias("of"), F.lit(r.path).alias("path"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in rules]
    table = spark.range(1).select(F.explode(F.array(*literal)).alias("r")).select("r.*") if rules else spark.createDataFrame([], "of string, path string, rule string, verdict string")
    hosts = thin.select("host").distinct().where("host <> ''")
    most = max((r.host.count(".") + 1 for r in rules), default=1)
    fitting = hosts.select("host", F.explode(_suffixes(F.col("host"), most)).alias("of")).join(table, "of").groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("size"), "verdict", "path", "rule")).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["path"])))  # the longest, then block over allow
    ruled = spread_join(thin, fitting, ["host"], ["page_id"], "left").select("page_id", "host", "path", best.alias("best"))
    ruled = materialise(ruled, "ruled-urls")
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("best.verdict") == "allow").alias("trusted"), F.count_if(F.col("best.verdict") == "block").alias("blocked"))
    edges = link_edges(pages.select(url_host(F.col("url")).alias("host"), "html")).unionByName(parent_edges(hosts))
    scores = propagated(edges, seeds)
    out = spread_join(ruled, scores, ["host"], ["page_id"], "left")
    more = F.coalesce(F.col("distrust"), F.lit(0.0)) > limit * F.coalesce(F.col("trust"), F.lit(0.0))
    by_graph = F.when(more & (F.coalesce(F.col("share"), F.lit(0.0)) > least), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_graph).alias("verdict"), "trust", "distrust", "share")
