"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b); nodes without an edge are not listed.

    Each round points all larger neighbours of a node at its smallest one, then all smaller ones too; the edges of a star stay,
    so it ends when a round changes nothing. Every round is written and the one before it freed; no node's neighbours are
    gathered: a hub's edges are short rows of a minimum and of joins that Spark splits where a key is hot.
    """
    e = scratch.write(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before, step = now, step + 1
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
