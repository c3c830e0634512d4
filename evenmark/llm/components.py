"""Connected components by alternating large-star and small-star steps: joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import merged


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
    return row["n"], row["h"]


def connected(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, component long): the smallest node that each node reaches.

    Each step replaces the edges of a node by edges to its smallest neighbour; it ends when the edges are stars,
    after a number of steps that grows with the logarithm of the longest path. Lineage is cut after each step.
    Nodes without edges are not returned; self-loops and repeated edges do no harm; nulls are left out.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = merged(e)
    before = _sum(e)
    for _ in range(most if before[0] else 0):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # minima as tables of their own, so that the joins may split the edges of a node with very many
        low = merged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = merged(large)
        down = merged(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        small = large.join(down, large["a"] == down["u"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = merged(small)
        after = _sum(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components: no fixed point")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
