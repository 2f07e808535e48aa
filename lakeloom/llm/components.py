"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v), v < u: neighbours move to the least vertex around."""
    both = edges.select("u", "v")
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    moved = joined.filter("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """`links` (a, b) to (id, component): the least id that each linked id can reach.

    Each round is written to the shared folder, so a lost executor costs one round. The number of
    rounds grows with the logarithm of the longest chain.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = settle(links.filter("a <> b").select(most.alias("u"), least.alias("v")).distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        edges = settle(_star(_star(edges, large=True), large=False), "links")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
