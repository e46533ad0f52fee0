"""Connected components of an edge table, by joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the component's smallest node.

    Each round links every node to the smallest label among its neighbours and then to that label's own
    label, so long chains halve; the labels are written to the shared folder after each round. Only a
    count of changed labels reaches the driver. Self-edges and repeated edges are harmless.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("root").alias("least"))
            .join(labels.withColumnRenamed("node", "a"), "a")
            .select(F.col("a").alias("node"), F.col("root").alias("old"), F.least("least", "root").alias("root"))
        )
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = stage(near.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "labels")
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels
