"""Distributed union-find: each node of a graph gets the smallest node it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v. Each
    node's neighbours are joined with their minimum; neighbour lists are never
    gathered, so a node of any degree is only rows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) for every node of ``links`` (a, b): root is the smallest node
    reachable, as a written table. Repeated links are allowed; of a loop its node
    stays if it has no other link. Each step is a written table; the number of
    steps follows the logarithm of the longest chain."""
    loops = links.filter("a = b").select(F.col("a").alias("id"))
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges)
    mark = None
    while True:
        got = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if got == mark or got[0] == 0:
            break
        mark, before = got, edges
        edges = scratch.keep(_star(before))
        scratch.drop(before)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
    alone = loops.distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("root"))
    out = scratch.keep(found.unionByName(alone))
    scratch.drop(edges)
    return out
