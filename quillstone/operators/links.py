"""Writing edges: validated links, removal, links by nearest vectors, retractions.

Tables are values: every operation returns the new rows or the new table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators import retrieval

# Relations, those that must point to an entity, and the types of a cause.
RELATIONS = ["supports", "contradicts", "derived_from", "related_to", "caused_by", "part_of", "about", "supersedes"]
TO_ENTITY, CAUSE_FROM, CAUSE_TO = ["about", "part_of"], ["event"], ["event", "fact"]


def broken(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """``id, rule``: edges that must not be written."""
    kinds = blocks.where(~F.coalesce("deleted", F.lit(False))).groupBy("id").agg(F.first("type").alias("type"))
    a, b = kinds.select(F.col("id").alias("source_id"), F.col("type").alias("source_type")), kinds.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"))
    joined = edges.join(a, "source_id", "left").join(b, "target_id", "left")
    there = F.col("source_type").isNotNull() & F.col("target_type").isNotNull()
    rules: dict[str, Column] = {
        "source does not exist": F.col("source_type").isNull(), "target does not exist": F.col("target_type").isNull(), "weight outside 0 to 1": ~F.col("weight").between(0, 1),
        "target must be an entity": there & F.col("relation").isin(TO_ENTITY) & (F.col("target_type") != "entity"),
        "cause must lead from an event to an event or fact": there & (F.col("relation") == "caused_by") & ~(F.col("source_type").isin(CAUSE_FROM) & F.col("target_type").isin(CAUSE_TO)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return joined.select("id", F.explode(found).alias("rule")).distinct()


def link(edges: DataFrame, new: DataFrame, blocks: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges with the valid new ones (upserted by id), the operations to log, and what was refused.

    ``new`` has ``id, source_id, target_id, relation, weight``; the last of equal ids in ``new`` order does not matter: the greatest weight wins.
    """
    refused = broken(new, blocks)
    one = Window.partitionBy("id").orderBy(F.desc_nulls_last("weight"), "source_id", "target_id", "relation")
    good = new.join(refused.select("id"), "id", "left_anti").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    good = good.withColumn("created_at", F.lit(at).cast("timestamp")).select(edges.columns)
    kept = edges.join(good.select("id"), "id", "left_anti").select(edges.columns)
    operations = good.select(F.col("source_id").alias("block_id"), F.lit("link").alias("action"), F.to_json(F.struct("relation", "target_id", "weight")).alias("data"))
    return kept.unionByName(good), operations, refused


def unlink(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges without those from ``source_id`` to ``target_id`` (of one ``relation`` where it is not null), and the number removed for each pair."""
    wanted = pairs.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), (F.col("relation") if "relation" in pairs.columns else F.lit(None).cast("string")).alias("r")).distinct()
    same = (F.col("source_id") == F.col("s")) & (F.col("target_id") == F.col("t")) & (F.col("r").isNull() | (F.col("relation") == F.col("r")))
    counts = edges.join(wanted, same).groupBy("source_id", "target_id").agg(F.count_distinct("id").alias("removed"))
    return edges.join(wanted, same, "left_anti").select(edges.columns), counts


def between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct edges from each ``source_id`` to each ``target_id`` asked for."""
    return edges.distinct().join(pairs.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_semi").select(edges.columns)


def vector_links(queries: DataFrame, records: DataFrame, most: int = 5, least: float = 0.5) -> DataFrame:
    """Links from new records ``id, vector`` to their nearest others: ``source_id, target_id, weight``."""
    found = retrieval.vector_search(queries.select(F.col("id").alias("query_id"), "vector"), records, most + 1).where((F.col("query_id") != F.col("id")) & (F.col("score") >= least))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    weight = F.round(F.least(F.lit(0.9), 0.3 + 1.2 * (F.col("score") - 0.5)), 6)
    return found.withColumn("n", place).where(F.col("n") <= most).select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), weight.alias("weight"))


def retractions(decisions: DataFrame) -> DataFrame:
    """Edges from the new record to each that it retracts: ``source_id, target_id, relation, weight``."""
    return decisions.where(F.col("decision") == "RETRACT").select(F.col("id").alias("source_id"), "target_id", F.lit("contradicts").alias("relation"), F.lit(1.0).alias("weight"))
