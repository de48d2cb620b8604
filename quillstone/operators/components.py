"""Connected components of a large edge set by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """From undirected ``a, b``: ``node, component`` (its smallest node). Nodes without an edge do not occur.

    Every round each node takes the smallest label around it and then that label's label, so labels travel
    twice as far each round. Labels are aggregated before they are shuffled; nothing reaches the driver but a count.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = scratch.cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    label = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "label")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = label.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        ahead = label.select(F.col("node").alias("new"), F.col("component").alias("jump"))
        moved = scratch.cut(step.join(ahead, "new").select("node", F.least("new", "jump").alias("component"), (F.least("new", "jump") != F.col("old")).alias("moved")), "label")
        scratch.drop(label)
        label = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return label
