"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): the smallest node reachable, for each node with an edge.

    Each round gives every node its smallest neighbour, then replaces both ends of each edge by
    these; edges within a label vanish. Rounds grow with the logarithm of a component's width.
    Counts alone reach the driver. No edges: an empty table. Null ends take no part.
    """
    shared_dir(edges.sparkSession)
    left = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    found = None
    while left.take(1):
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a"))).toDF("node", "other")
        label = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")).checkpoint()
        at = F.col("label")
        left = (
            left.join(label.select(F.col("node").alias("a"), at.alias("la")), "a")
            .join(label.select(F.col("node").alias("b"), at.alias("lb")), "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct()
            .checkpoint()
        )
        if found is None:
            found = label.select("node", at.alias("component"))
        else:
            step = label.select(F.col("node").alias("component"), at.alias("next"))
            found = found.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")).checkpoint()
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
