"""Structural graph operators over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def unresolved(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (src, target) whose target is no node."""
    return references.join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def unreferenced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def reverse_closure(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, depth): the changed nodes and everything that depends on them, with the fewest steps. edges: src depends on dst.

    A breadth-first loop that ends when nothing new is reached, whatever the depth; each round joins only the newly reached
    nodes and writes them, which cuts lineage. The rounds' tables are put together as their number doubles, so a round reads
    few files and a row is written a logarithmic number of times.
    """
    front = materialize(changed.select("id").distinct().withColumn("depth", F.lit(0)))
    # Tables of reached nodes with the number of rounds in each, like the digits of a counter.
    parts, depth = [(1, front)], 0
    edges = materialize(edges.select("src", "dst"))
    while not front.isEmpty():
        depth += 1
        step = edges.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id")).distinct()
        for _, known in parts:
            step = step.join(known.select("id"), "id", "left_anti")
        front = materialize(step.withColumn("depth", F.lit(depth)))
        parts.append((1, front))
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (n, b), (m, a) = parts.pop(), parts.pop()
            parts.append((n + m, materialize(a.unionByName(b))))
    return reduce(DataFrame.unionByName, [t for _, t in parts])


def single_candidate(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of keys that have exactly one; several give null, never an arbitrary one."""
    return rows.groupBy(*keys).agg(F.when(F.countDistinct(value) == 1, F.min(value)).alias(value))
