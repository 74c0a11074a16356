"""Connected components of a table of edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.tables import merged, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); the component is its smallest node.

    A round takes the smallest label among the neighbours and then follows labels to their own label, so
    the longest chain shrinks by half or better. Joins and minima only: a hub's edges are pre-aggregated
    and AQE splits its join partition. Rounds are written to the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(merged(labels.select(F.col("node").alias("b"), "label")), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(merged(near), "node").select("node", "label", F.least("label", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("label").alias("over"))
        moved = written(least.join(merged(jump), "least").select("node", F.least("least", "over").alias("new"), "label"), "labels")
        if moved.where("new != label").isEmpty():
            return moved.select("node", F.col("new").alias("component"))
        labels = moved.select("node", F.col("new").alias("label"))
