"""Connected components of a graph given as edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the smallest node it can reach.

    Each round gives both ends of an edge the smaller of their labels and then follows each label once (label of the
    label), so labels travel ever longer steps; rounds grow with the logarithm of the longest chain. Every round's
    labels are written to the shared folder: a lost executor costs one round at most.
    """
    edges = materialise(edges.where("a <> b").select("a", "b"), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialise(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
        apart = edges.join(la, "a").join(lb, "b").where("la <> lb")
        told = apart.select(F.explode(F.array("a", "b")).alias("node"), F.least("la", "lb").alias("label"), F.lit(None).cast("long").alias("old"))
        lower = labels.withColumn("old", F.col("label")).unionByName(told).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        lower = materialise(lower, "labels")
        if not lower.where("label < old").limit(1).count():
            return labels
        hop = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = materialise(lower.join(hop, "label").select("node", F.least("label", "next").alias("label")), "labels")
