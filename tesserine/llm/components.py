"""Connected components by alternating large-star and small-star steps.

Each step hangs the neighbours of a node on its smallest one; after O(log^2 n)
rounds every component is a star.  Edges are only ever aggregated to a minimum
and joined back, so a node with very many neighbours is no hot task, and
nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm.common import checkpoint, slim


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); a component is named by its least node."""
    edges = checkpoint(slim(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
    before = edges.agg(*mark).first()
    while True:
        edges = checkpoint(slim(_small_star(_large_star(edges))))
        after = edges.agg(*mark).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
