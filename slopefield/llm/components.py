"""Connected components of an edge table, by contraction; nothing reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopefield.llm.common import stored


def _roots(parent: DataFrame) -> DataFrame:
    """Follow parents (always smaller nodes) to their ends, doubling the step each time."""
    while True:
        upper = parent.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
        step = stored(
            parent.join(upper, F.col("up") == F.col("_n"), "left").select(
                "node", "up", F.coalesce("_up", "up").alias("further")
            ),
            "roots",
        )
        parent = step.select("node", F.col("further").alias("up"))
        if step.where("up <> further").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Each round every node points to its smallest neighbour, trees are flattened and
    edges renamed to their roots; a round at least halves the nodes that still have edges.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = stored(edges.select(*ends).where("a <> b").distinct(), "edges")
    labels = left.selectExpr("a AS node", "a AS component").limit(0)
    first = True
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        parent = stored(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")),
            "parents",
        )
        parent = _roots(parent)
        if first:
            labels, first = parent.select("node", F.col("up").alias("component")), False
        else:
            root = parent.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            labels = stored(
                labels.join(root, F.col("component") == F.col("_n"), "left").select(
                    "node", F.coalesce("_up", "component").alias("component")
                ),
                "labels",
            )
        for end in ("a", "b"):
            root = parent.select(F.col("node").alias("_n"), F.col("up").alias("_up"))
            left = left.join(root, F.col(end) == F.col("_n")).withColumn(end, F.col("_up"))
            left = left.select("a", "b")
        left = stored(left.select(*ends).where("a <> b").distinct(), "edges")
    return labels
