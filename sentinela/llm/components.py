"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm._base import stash


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); label is the smallest node reachable.

    Each turn every component hooks to the smallest label next to it, chains of
    hooks are followed to their end, and all nodes move there, so the number of
    unfinished components at least halves. Turns are written to the shared
    scratch folder and end when no edge joins two labels. Hot nodes and labels
    only occur as the larger side of joins between written tables, which Spark
    can split, and in pre-aggregated minima. An empty table has no nodes.
    """
    edges = stash(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stash(nodes.withColumn("label", F.col("node")), "labels")
    while True:
        left = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        open_ = stash(edges.join(left, "a").join(right, "b").where("la != lb").select("a", "b", "la", "lb"), "open")
        if open_.isEmpty():
            return labels
        edges = open_.select("a", "b")
        hooks = stash(open_.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to"))
                      .groupBy("label").agg(F.min("to").alias("to")), "hooks")
        while True:
            ahead = hooks.select(F.col("label").alias("to"), F.col("to").alias("further"))
            jumped = stash(hooks.join(ahead, "to", "left").select(
                "label", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("label", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = stash(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")),
                       "labels")
