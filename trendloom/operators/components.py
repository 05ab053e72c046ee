"""Connected components of a graph of any shape in a number of rounds that grows with the
logarithm of its longest path.

Each round makes two steps over all edges: every node hands its larger neighbours to its
smallest one (large star), then its smaller ones (small star). Edges become stars around the
smallest node of each component; a hot node is the key of an aggregate that combines on the
map side and of a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.sources.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    return down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for each node of edges (a, b); without edges no rows."""
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = None
    while (now := mark(edges)) != before:
        before = now
        edges = materialize(_small_star(_large_star(edges)), "edges")
    centers = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centers)
