"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common

#: Edges of one partition.
ROWS = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b) but each component's smallest, which is its name.

    Every round is two joins with per-node minima, each a partial aggregation, so a node with very many
    edges is never gathered in one task; the edges of a round are a table in the shared folder.
    """
    scratch = common.Scratch()
    parts = max(1, -(-edges.count() // ROWS))  # partitions follow the edges, which may be far fewer than the documents

    def few(frame: DataFrame) -> DataFrame:
        return frame.coalesce(parts)

    stars = scratch.written(few(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()), "edges")
    while not _are_stars(stars, parts):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.written(few(least), "least")  # a join above two plain exchanges can split a hot node
        large = few(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        large = scratch.written(few(large), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = scratch.written(few(few(small.filter("u > v")).distinct()), "edges")
        scratch.drop(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _are_stars(edges: DataFrame, parts: int) -> bool:
    """Whether every node has one edge down at most, and none that is the lower end of an edge has any."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).coalesce(parts).filter("down > 1 or (down = 1 and up = 1)").isEmpty()
