"""Connected components by alternating star contraction, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stampmill.llm.tables import dropped, kept


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root: every node on an edge (u, v of longs) with the smallest node it is linked to.

    Each round joins every node's larger neighbours, then its smaller ones, to the smallest of them, so
    rounds grow with the logarithm of the longest chain. A node's list is never gathered: only its
    minimum is, and rows are joined back to that, from a stored table so that a hot node can be split.
    """
    now = kept(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        ways = _both_ways(now)
        least = kept(ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = ways.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # Small star: every node points its smaller neighbours, and itself, at the smallest.
        low = kept(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large-star")
        floor = kept(low.groupBy("u").agg(F.min("v").alias("m")), "floor")
        small = low.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, now = now, kept(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        dropped(last, least, low, floor)
        # Done when every node points at one other, and none that is pointed at points on.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter((F.col("out") > 1) | (F.col("out") * F.col("into") > 0)).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
