"""Exact duplicates by content hash, and their merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators import retrieval


def hashed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("hash", scalars.content_hash(F.col("content")))


def duplicates(blocks: DataFrame) -> DataFrame:
    """``hash, keep_id, n`` of live records that share a hash; the oldest, then smallest id, is kept."""
    live = hashed(blocks.where("not deleted"))
    return live.groupBy("hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("keep_id"), F.count("*").alias("n")).where("n > 1")


def merged(blocks: DataFrame) -> DataFrame:
    """One record per hash with the tags of all and the greatest confidence."""
    live = hashed(blocks.where("not deleted"))
    one = live.groupBy("hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), F.max("confidence").alias("confidence"))
    # distinct tags first: a hash in a third of all rows brings no more than its different tags to one row
    tags = live.select("hash", F.explode("tags").alias("tag")).distinct().groupBy("hash").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return one.join(tags, "hash", "left").select("hash", "id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "confidence")


def semantic(new: DataFrame, known: DataFrame, least: float = 0.95) -> DataFrame:
    """``id, keep_id, similarity``: new records ``id, vector`` whose nearest known record (``id, vector``) is at least so similar."""
    best = retrieval.vector_search(new.select(F.col("id").alias("query_id"), "vector"), known, 2).where(F.col("query_id") != F.col("id"))
    first = best.groupBy("query_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("rank"))).alias("x"))
    return first.where(F.col("x.score") >= least).select(F.col("query_id").alias("id"), F.col("x.id").alias("keep_id"), F.col("x.score").alias("similarity"))


def store(new: DataFrame, known: DataFrame, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """The records to write, and ``id, stored_id`` of all of ``new``, under a policy for copies by hash, in the batch and of known live records.

    ``skip`` and ``return_existing`` keep what is there; ``merge`` also gives it all tags and the greatest confidence (its row is among
    those to write); ``error`` refuses the batch if it holds a copy.
    """
    if policy not in ("skip", "return_existing", "merge", "error"):
        raise ValueError("the policy is skip, return_existing, merge or error")
    live = hashed(known.where(~F.coalesce("deleted", F.lit(False)))).groupBy("hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("old"))
    batch = hashed(new)
    first = batch.groupBy("hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("first"))
    placed = batch.select("id", "hash").join(first, "hash").join(live, "hash", "left").select("id", "hash", F.coalesce("old", "first").alias("stored_id"))
    copies = placed.where("id <> stored_id")
    if policy == "error" and not copies.isEmpty():
        raise ValueError("the batch holds copies")
    written = new.join(placed.where("id = stored_id").select("id"), "id", "left_semi").select(new.columns)
    if policy != "merge":
        return written, placed.select("id", "stored_id")
    both = known.select(new.columns).unionByName(new)
    touched = placed.join(copies.select("stored_id").distinct(), "stored_id", "left_semi").select("stored_id", "id")
    own = touched.unionByName(touched.select("stored_id", F.col("stored_id").alias("id"))).distinct().join(both.select("id", "tags", "confidence"), "id")
    best = own.groupBy("stored_id").agg(F.max("confidence").alias("_confidence"))
    tags = own.select("stored_id", F.explode("tags").alias("tag")).groupBy("stored_id").agg(F.array_sort(F.collect_set("tag")).alias("_tags"))
    rows = both.join(best.join(tags, "stored_id", "left").withColumnRenamed("stored_id", "id"), "id")
    rows = rows.withColumn("tags", F.coalesce("_tags", "tags")).withColumn("confidence", F.col("_confidence")).select(new.columns).dropDuplicates(["id"])
    return written.join(rows.select("id"), "id", "left_anti").unionByName(rows), placed.select("id", "stored_id")
