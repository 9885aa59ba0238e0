"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): the smallest node that it reaches.

    Each round replaces a node's edges by edges to its smallest neighbour, so the table never has more
    edges than before and no neighbourhood is gathered in a task. It ends when nothing changes. Nodes only in
    loops (u = v) are their own root.
    """
    def turned(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def large(e: DataFrame) -> DataFrame:
        both = turned(e)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    nodes = edges
    now = cut(edges.where("u != v").select("u", "v").distinct())
    before = None
    while (after := state(now)) != before:
        before = after
        now = cut(small(large(now).where("u != v").distinct()).where("u != v").distinct())
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    every = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return every.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
