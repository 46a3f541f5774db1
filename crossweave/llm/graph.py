"""Connected components of an edge table, by alternating large and small stars.

A vertex with very many neighbours is one key of the join that gives each neighbour the least one; it is spread over tasks.
Null vertices and loops link nothing, repeated edges count once, and an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossweave.llm.common import cut, spread_join

EDGES_A_PARTITION = 250_000


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(pairs: DataFrame, spread: bool) -> DataFrame:
    """(u, v) with m, the least of u and its v; spread: the table has more than one partition."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return spread_join(pairs, least, ["u"], ["v"]) if spread else pairs.join(least, "u")


def _round(edges: DataFrame, spread: bool) -> DataFrame:
    # a union of single partitions is made one again, so that nothing is exchanged
    one = (lambda x: x) if spread else (lambda x: x.coalesce(1))
    large = _star(one(_neighbours(edges)), spread).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    small = _star(cut(down) if spread else down, spread)
    linked = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return one(linked).where("a <> b").distinct()


def components(edges: DataFrame, edges_a_part: int = EDGES_A_PARTITION) -> DataFrame:
    """(id, component) of the vertices of edges (a, b), both long: the least id that links reach. Every round is a reliable checkpoint."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # edges never become more; a graph of one partition needs no exchange at all
    parts = 1 + edges.count() // edges_a_part
    spread = parts > 1
    edges = edges.coalesce(parts)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, edges = now, cut(_round(edges, spread).coalesce(parts))
    children = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = children.select(F.col("component").alias("id"), "component").distinct()
    return children.unionByName(roots)
