"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of a link ``a, b``; the component is its smallest node.

    Large-star and small-star steps by turns: neighbours are tied to the least one of them until nothing changes.
    The number of links never grows, no node's neighbours are gathered, and every step is written and read again.
    """
    larger = F.col("a") > F.col("b")
    edges = links.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.where("a <> b").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a").where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        edges = cut_lineage(small.unionByName(least.withColumnRenamed("_m", "b")).where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    tied = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return tied.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
