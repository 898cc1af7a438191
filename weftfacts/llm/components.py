"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, replicated, salt


def _lowest(arcs: DataFrame) -> DataFrame:
    """The smallest of each node's neighbours and itself; combined on the map side, so a hub is a few rows a task."""
    return arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _to_lowest(arcs: DataFrame) -> DataFrame:
    """Each arc (a, b) with the smallest node around a; a hub's arcs are spread over salts."""
    return arcs.withColumn("salt", salt(F.col("b"))).join(replicated(_lowest(arcs)), ["a", "salt"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component. Loops and repeats are allowed.

    Each round writes the edges to the shared folder, which cuts lineage. The rounds needed grow with the logarithm of the
    longest path; the loop ends when a round leaves every edge as it was (the steps never add an edge and lower a node's neighbours, so they end).
    """
    e = materialize(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_to_lowest(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        joined = _to_lowest(large)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        new = materialize(small.filter("a <> b").distinct())
        # Exactly unchanged: as many edges, and none of them new.
        settled = new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty()
        release(large, e)
        e = new
        if settled:
            break
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
