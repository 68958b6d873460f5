"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long; root is one node of the component.

    Each round points every node at the smallest of itself and its neighbours, puts the pointers
    in the place of the edges' ends and drops what became a loop, until no edge is left. Node ids
    should be well mixed (hashes), so that many nodes are smallest among their neighbours and the
    graph shrinks by a constant factor a round. Joins are between stored tables, so a node with very
    many edges is split by adaptive execution; minima are pre-aggregated. Null ends are ignored."""
    edges = materialise(edges.select("a", "b").filter("a is not null and b is not null"), "edges")
    mapping = None
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        step = materialise(both.groupBy(F.col("a").alias("node"))
                           .agg(F.least(F.col("node"), F.min("b")).alias("to")), "pointers")
        if mapping is None:
            mapping = step.withColumnRenamed("to", "root")
        else:
            mapping = materialise(
                mapping.join(step.select(F.col("node").alias("root"), "to"), "root", "left")
                .select("node", F.coalesce("to", "root").alias("root")), "components")
        shrunk = materialise(
            edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        if shrunk.isEmpty():
            return mapping
        edges = shrunk
