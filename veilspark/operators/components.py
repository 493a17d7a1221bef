"""Connected components of a link table, by alternating large-star and small-star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop_staged, staged


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link. Each step links a node's larger
    neighbours (then its smaller ones) to its least neighbour; a node with very many links is joined with one row, and rows
    that agree are merged before they move. Steps go on until nothing changes; their number grows with the logarithm of
    the longest chain. Nodes are of any type that has an order."""
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct()
    edges = staged(edges, "edges")
    before = _sums(edges)
    while before[0]:
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        last, edges = edges, staged(_star(large, larger=False), "edges")
        drop_staged(last)
        after = _sums(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links of each node's neighbours (the larger ones, or the smaller ones and itself) to the least of its neighbours and itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = edges.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _sums(edges: DataFrame) -> tuple:
    """The number of links and two sums of hashes: equal for equal sets of links."""
    both = (F.xxhash64(*c).cast("decimal(38,0)") for c in (("u", "v"), ("v", "u")))
    return tuple(edges.agg(F.count("*"), *map(F.sum, both)).first())
