"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, alone: int = 200_000) -> DataFrame:
    """links (u, v) -> (node, component): the smallest node that each node reaches, for nodes other than
    that smallest one.  Every round is two joins on edges; nothing is gathered by component.  Up to `alone` edges are
    one task's work, without any shuffle."""
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = _mark(edges)
    while mark[0]:
        # One partition needs no exchange; more are dealt out by the joins.
        edges_in = edges.coalesce(1) if mark[0] <= alone else edges
        both = edges_in.union(edges_in.select("v", "u")).toDF("u", "v")
        both = both.coalesce(1) if mark[0] <= alone else both
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(parent.select("u", F.col("m").alias("v")))
        older, edges = edges, cut(small.distinct())
        drop(older)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    edges = edges.coalesce(1) if mark[0] <= alone else edges
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
