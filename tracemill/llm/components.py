"""Connected components by alternating large and small stars.

Every step is an aggregation and a join on the node, so nothing gathers a whole component. The
minima are written before they are joined: both sides of the join are then plain exchanges, which
adaptive execution splits when a hub has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import materialise


def _least(rows: DataFrame) -> DataFrame:
    """The smallest neighbour or self of every u, as m."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"))
    return materialise(least.select("u", F.least("u", "m").alias("m")), "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    others = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root hangs on another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 OR (up = 1 AND down = 1)").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    ``edges`` has two columns of integers. Self-links and rows with NULL are ignored.
    """
    first, second = (F.col(c) for c in edges.columns)
    # From here on u > v. Neither star makes more rows than it gets, so one distinct a round will do.
    edges = edges.where(first != second).select(
        F.greatest(first, second).alias("u"), F.least(first, second).alias("v")
    )
    edges = materialise(edges.distinct(), "edges")
    while not _are_stars(edges):
        large = materialise(_large_star(edges), "edges")
        edges = materialise(_small_star(large).distinct(), "edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
