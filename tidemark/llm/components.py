"""Connected components of a graph of any shape, in a number of rounds that grows with the logarithm of its size."""

from pyspark.sql import DataFrame, functions as F

from tidemark.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of each node in ``links`` (columns ``a``, ``b``); the component is its smallest node.

    Large-star and small-star steps alternate: every node hands its larger neighbours, then its smaller ones, to the
    smallest node it knows, until all nodes point at the smallest one of their component. Each round is written, so
    that plans stay short and a lost executor reads the round again. Hubs are joined, never gathered. Null ends and
    loops are left out.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, seen = materialize(ends.distinct(), "components"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialize(small, "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        seen = state
