"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import written


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (the smallest node of its component) for every node of edges (a, b).

    Alternates two steps until each component is a star around its smallest node: each node hands its larger
    neighbours to its smallest neighbour, then its smaller ones. A step is a grouped minimum and a join on the node;
    neighbours are never gathered. Edges are written between steps. Self loops, repeated edges and either
    direction are allowed; rows with a null end are left out; no edges give no rows. Rounds grow with the logarithm
    of the longest path; a RuntimeError says that most_rounds weren't enough.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def settled(e: DataFrame) -> bool:
        """No node has two smaller neighbours, or one as well as larger ones."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        return not ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 OR low = 1 AND high = 1").limit(1).count()

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        if settled(edges):
            break
        edges = written(small_star(written(large_star(edges), "edges")), "edges")
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
