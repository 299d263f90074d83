"""Connected components of an edge table, by hooking roots to smaller ones and contracting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cambium.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, label): label is the smallest node that can be reached. Nodes without an edge to another are not in it; null ends and loops are skipped.

    A round sends each root to the smallest root beside it, follows those pointers to their ends, and renames both ends of the edges, which merges
    most of them; rounds grow with the logarithm of a component's width. A node with very many edges is met only in sums by key and in joins that can be split.
    """
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = live.select(F.col("a").alias("node")).union(live.select(F.col("b").alias("node"))).distinct().select("node", F.col("node").alias("label"))
    while live.take(1):
        hook = written(live.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to")), "hook")
        while True:
            after = hook.select(F.col("root").alias("to"), F.col("to").alias("beyond"))
            hook = written(hook.join(after, "to", "left").select("root", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")), "hook")
            if not hook.where("moved").take(1):
                break
            hook = hook.select("root", "to")
        hook = hook.select("root", "to")
        label = written(label.join(hook, label["label"] == hook["root"], "left").select("node", F.coalesce("to", "label").alias("label")), "label")
        for end in ("a", "b"):
            live = live.join(hook, live[end] == hook["root"], "left").withColumn(end, F.coalesce("to", end)).drop("root", "to")
        live = written(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return label
