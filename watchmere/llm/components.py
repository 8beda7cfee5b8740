"""Connected components of a graph given by its edges, as joins and map-side minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchmere.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of an edge with the smallest node of its component.

    Every round takes the smallest root among neighbours and then the root of that root, so paths shrink by half at
    least. Rounds are written to the shared checkpoint folder. Only the number of changed nodes reaches the driver.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node <> near")
    both = cut_lineage(both.union(both.select("near", "node")).distinct())
    roots = cut_lineage(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("root")))
    while True:
        around = both.join(roots.select(F.col("node").alias("near"), "root"), "near").select("node", "root")
        nearest = around.union(roots).groupBy("node").agg(F.min("root").alias("root"))
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = nearest.join(above, "root", "left").select("node", F.least("root", "higher").alias("root"))
        following = cut_lineage(jumped)
        moved = following.join(roots.withColumnRenamed("root", "old"), "node").filter("root <> old")
        done = moved.isEmpty()
        roots = following
        if done:
            return roots
