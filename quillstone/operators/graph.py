"""Typed edges: neighbours, breadth-first search, shortest paths, links by shared tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.plans.scratch import Scratch


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, relation, weight`` in both directions; edges without an end are left out."""
    good = edges.where("source_id is not null and source_id <> '' and target_id is not null and target_id <> ''").select("id", "source_id", "target_id", "relation", "weight").distinct()
    out = good.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "relation", "weight")
    return out.unionByName(good.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "relation", "weight"))


def live_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct ``a, b`` in both directions between live records."""
    live = blocks.where("not deleted").select("id").distinct()
    both = undirected(edges).where("a <> b").select("a", "b").distinct()
    return both.join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")


def neighbours(edges: DataFrame, blocks: DataFrame, relation: str | None = None, direction: str = "both") -> DataFrame:
    """``id, neighbour`` over live records."""
    if relation:
        edges = edges.where(F.col("relation") == relation)
    if direction == "both":
        return live_edges(edges, blocks).select(F.col("a").alias("id"), F.col("b").alias("neighbour"))
    live = blocks.where("not deleted").select("id").distinct()
    a, b = ("source_id", "target_id") if direction == "outgoing" else ("target_id", "source_id")
    found = edges.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).distinct()
    return found.join(live.select(F.col("id").alias("neighbour")), "neighbour", "left_semi").select("id", "neighbour")


def traverse(starts: DataFrame, live: DataFrame, scratch: Scratch, depth: int = 3) -> DataFrame:
    """``start, id, depth``: breadth-first from many starts over ``live`` (``a, b``); starts are left out."""
    seen = scratch.cut(starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("depth")).distinct(), "seen")
    front = seen
    for d in range(1, depth + 1):
        step = front.join(live, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        front = scratch.cut(step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def shortest_path(start: str, end: str, edges: DataFrame, scratch: Scratch) -> list[str]:
    """Ids on a shortest undirected path, deleted records included; empty without one."""
    if start == end:
        return [start]
    spark = edges.sparkSession
    steps = scratch.cut(undirected(edges).select("a", "b").distinct(), "steps")
    seen = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    front = seen
    while True:
        step = front.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        front = scratch.cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti").select("id", "path"), "front")
        hit = front.where(F.col("id") == end).head()
        if hit or front.isEmpty():
            return hit["path"] if hit else []
        seen = seen.unionByName(front)


def tag_links(blocks: DataFrame, recent: int = 50, most: int = 5) -> DataFrame:
    """Links to the records sharing most tags: ``source_id, target_id, weight``.

    Of every tag the newest ``recent`` records link to each other, as the semantics demand; that also bounds the join.
    """
    tagged = blocks.where("not deleted").select("id", "created_at", F.explode(F.array_distinct("tags")).alias("tag"))
    newest = tagged.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("created_at"), "id"))).where(F.col("n") <= recent)
    pair = newest.select("tag", F.col("id").alias("source_id")).join(newest.select("tag", F.col("id").alias("target_id")), "tag").where("source_id <> target_id")
    shared = pair.groupBy("source_id", "target_id").agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("shared"), "target_id"))
    return shared.withColumn("n", best).where(F.col("n") <= most).select("source_id", "target_id", F.round(F.least(F.lit(1.0), 0.3 + 0.2 * F.col("shared")), 6).alias("weight"))
