"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and a join that the adaptive planner may
split, so a node with very many neighbours never meets in one task. Each round's edges are written to
the shared folder: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed pairs (a, b), a > b in the stored form."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:  # every larger neighbour, and the node itself, hangs on the least of the neighbourhood
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def connected_components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that is reachable.

    Loops and repeated edges are allowed; rows with a null end are no edges. A node whose edges are
    only loops is not returned, nor is one without edges: it is its own component.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = stored(pairs.distinct(), name)
    while True:
        # Finished when every edge ends in a node that is no edge's start, and every start has one edge.
        starts = current.groupBy("a").agg(F.count("*").alias("n"))
        open_ = starts.where("n > 1").select("a").union(
            current.select(F.col("b").alias("a")).join(starts.select("a"), "a", "left_semi")).limit(1).count()
        if not open_:
            break
        current = stored(_star(_star(current, large=True), large=False), name)
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
