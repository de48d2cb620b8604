"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import copies, leaks, near, neighbours, packing, private, sentences
from quillstone.operators.components import components
from quillstone.plans.scratch import Scratch
from quillstone.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "p2")
    return copies.copies(copies.record_keys(table(spark, folder, "blocks"), scratch), scratch)[1]


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every record that has copies, with their number."""
    scratch = Scratch(spark, "p2")
    groups, _ = copies.copies(copies.record_keys(table(spark, folder, "blocks"), scratch), scratch)
    return groups.select(F.col("keep").alias("keep_id"), (F.col("n") - 1).alias("n_copies"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    graph = neighbours.neighbour_graph(table(spark, folder, "block_embeddings"), Scratch(spark, "p3"), dimensions=64)
    near = neighbours.nearest(graph, 5, 0.9)
    return near.select(F.least("id", "neighbour").alias("block_a"), F.greatest("id", "neighbour").alias("block_b")).distinct()


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar block_ids of every usable embedding."""
    graph = neighbours.neighbour_graph(table(spark, folder, "block_embeddings"), Scratch(spark, "p3"), dimensions=64)
    return neighbours.nearest(graph).select(F.col("id").alias("block_id"), "rank", "neighbour", "similarity")


def p3_search(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy graph search for every embedding of table ``embeddings`` whose vec_id is divisible by 20."""
    scratch = Scratch(spark, "p3")
    graph = neighbours.neighbour_graph(table(spark, folder, "block_embeddings"), scratch, dimensions=64)
    queries = table(spark, folder, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return neighbours.greedy_search(queries, graph, scratch).select(F.col("qid").cast("bigint").alias("vec_id"), "neighbour", "similarity")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    clean = private.sanitise(table(spark, folder, "blocks"), Scratch(spark, "p5"))
    return clean.select(F.col("id").alias("block_id"), F.explode("kinds").alias("kind")).distinct()


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every block's content with typed placeholders."""
    return private.sanitise(table(spark, folder, "blocks"), Scratch(spark, "p5")).select(F.col("id").alias("block_id"), "clean").distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.member_pairs(*near.near_duplicates(table(spark, folder, "blocks"), Scratch(spark, "p6")))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every block with its group of similar texts and its class's number of similar classes."""
    scratch = Scratch(spark, "p6")
    members, similar = near.near_duplicates(table(spark, folder, "blocks"), scratch)
    links = similar.union(similar.select("b", "a")).groupBy(F.col("a").alias("rid")).agg(F.count("*").alias("n_links"))
    group = components(similar, scratch).select(F.col("node").alias("rid"), F.col("component"))
    known = members.join(links, "rid", "left").join(group, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    names = known.groupBy("component").agg(F.min("id").alias("group_id"))
    return known.join(names, "component").select(F.col("id").alias("block_id"), "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every text, or piece of one that exceeds the capacity, with its container, for each capacity."""
    counts = packing.token_counts(table(spark, folder, "documents"))
    return packing.pack(counts, table(spark, folder, "context_budgets"), Scratch(spark, "p8")).withColumnRenamed("id", "doc_id")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and the share of unused space by capacity."""
    budgets = table(spark, folder, "context_budgets").select(F.col("budget_id"), "capacity_tokens")
    boxes = p8_pack(spark, folder).groupBy("budget_id").agg(F.count_distinct("container").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    return boxes.join(budgets, "budget_id").withColumn("unused", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The longest verbatim match of every leaked item in every document."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without a leaked item."""
    documents = table(spark, folder, "documents")
    return leaks.without_leaks(documents, leaks.find_leaks(documents, table(spark, folder, "eval_items"))).select("doc_id", "source")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents")).select("doc_id", "start_at")


def p10_units(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence unit with its place and text."""
    return sentences.sentence_units(table(spark, folder, "documents"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_nearest": p3_nearest, "p3_search": p3_search, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_groups": p6_groups, "p8_pack": p8_pack, "p8_fill": p8_fill, "p9_found": p9_found, "p9_matches": p9_matches, "p9_clean": p9_clean, "p10_found": p10_found, "p10_units": p10_units}

_WORDS = r"regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+')"

ORACLES: dict[str, str] = {
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[n:n+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS n FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[n:n+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS n FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
