"""Connected components by alternating stars: minima and joins, no group gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import discard, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) of all nodes of the links. Links of a node to itself and repeated links don't matter; null ends make no link."""
    u, v = F.col("u"), F.col("v")

    def stars(edges: DataFrame, both_ways: bool) -> DataFrame:
        """Edges (v, least): of the larger neighbours of each node, or of the smaller ones and the node itself."""
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = edges.join(least, "u")
        moved = moved.where(v > u).select(v.alias("u"), F.col("m").alias("v")) if both_ways else moved.select(v.alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where(u != v).distinct()

    def doubled(edges: DataFrame) -> DataFrame:
        return edges.select("u", "v").unionByName(edges.select(v.alias("u"), u.alias("v")))

    def state(edges: DataFrame) -> tuple:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = state(edges)
    while True:
        large = stars(doubled(edges), both_ways=True)
        downwards = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        older, edges = edges, written(stars(downwards, both_ways=False))
        discard(older)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(u.alias("node"), v.alias("component")).unionByName(edges.select(v.alias("node"), v.alias("component"))).distinct()
