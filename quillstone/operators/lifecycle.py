"""Changing records: updates, deletions with cascade or new parents, moves, embeddings; every change names the operations to log.

Tables are values: each function returns the tables after the change. ``blocks`` has one row per id.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars
from quillstone.operators import hierarchy
from quillstone.plans.scratch import Scratch

# The types that a record of a type may have as parent; every type may be without one.
PARENTS = {"fact": ["entity", "fact"], "preference": ["entity", "preference"], "event": ["entity", "event"], "entity": ["entity"], "relation": ["entity"], "episode": ["episode"], "experience": ["entity"]}
#: Columns that an update may set.
CHANGEABLE = ["content", "tags", "confidence", "source", "decay_rate", "ttl", "happened_at", "happened_at_end", "temporal_precision", "custom_metadata"]


@dataclass(frozen=True)
class Tables:
    blocks: DataFrame
    edges: DataFrame
    embeddings: DataFrame
    #: ``block_id, action, data``, to be appended to the log
    operations: DataFrame | None = None


def _logged(ids: DataFrame, action: str, data: Column | None = None) -> DataFrame:
    return ids.select(F.col("id").alias("block_id"), F.lit(action).alias("action"), (F.lit("{}") if data is None else data).alias("data"))


def parent_violations(blocks: DataFrame) -> DataFrame:
    """``id, rule``: records whose parent does not exist or is of a type that does not fit."""
    up = blocks.where(~F.coalesce("deleted", F.lit(False))).groupBy(F.col("id").alias("parent_id")).agg(F.first("type").alias("parent_type"))
    fits = F.lit(False)
    for kind, allowed in PARENTS.items():
        fits = fits | ((F.col("type") == kind) & F.col("parent_type").isin(allowed))
    joined = blocks.where("parent_id is not null").join(up, "parent_id", "left")
    rule = F.when(F.col("parent_type").isNull(), "parent does not exist").when(~F.coalesce(fits, F.lit(False)), "parent is of another type")
    return joined.select("id", rule.alias("rule")).where("rule is not null").distinct()


def update(tables: Tables, changes: DataFrame) -> Tables:
    """``changes`` has ``id`` and some of ``CHANGEABLE``; null means unchanged. The version rises, a new content gets a new hash and loses its vector.

    Of several rows for an id each column takes its greatest value; deleted and unknown ids change nothing.
    """
    names = [c for c in CHANGEABLE if c in changes.columns]
    one = changes.groupBy("id").agg(*[F.max(c).alias(f"_{c}") for c in names]).withColumn("_hit", F.lit(True))
    live = ~F.coalesce("deleted", F.lit(False)) & F.col("_hit").isNotNull()
    joined = tables.blocks.join(one, "id", "left")
    new_text = live & F.col("_content").isNotNull() & ~F.col("_content").eqNullSafe(F.col("content")) if "content" in names else F.lit(False)
    joined = joined.withColumn("_live", live).withColumn("_text", new_text)
    data = F.to_json(F.struct(*[F.col(f"_{c}").alias(c) for c in names]))
    operations = _logged(joined.where("_live"), "update", data)
    embeddings = tables.embeddings.join(joined.where("_text").select(F.col("id").alias("block_id")), "block_id", "left_anti").select(tables.embeddings.columns)
    for c in names:
        joined = joined.withColumn(c, F.when(F.col("_live"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    joined = joined.withColumn("version", F.coalesce("version", F.lit(1)) + F.when(F.col("_live"), 1).otherwise(0))
    if "content_hash" in joined.columns and "content" in names:
        joined = joined.withColumn("content_hash", F.when(F.col("_text"), scalars.content_hash(F.col("content"))).otherwise(F.col("content_hash")))
    return Tables(joined.select(tables.blocks.columns), tables.edges, embeddings, operations)


def _without(tables: Tables, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and vectors that do not touch ``id``."""
    edges = tables.edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_anti")
    return edges.select(tables.edges.columns), tables.embeddings.join(ids.select(F.col("id").alias("block_id")), "block_id", "left_anti").select(tables.embeddings.columns)


def _reparented(blocks: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """Parents and children lists after ``gone`` left: orphans move up to the nearest ancestor that stays."""
    up = blocks.select(F.col("id").alias("v"), F.col("parent_id").alias("up")).where("up is not null")
    moves = scratch.cut(gone.join(up.select(F.col("v").alias("id"), "up"), "id", "left").select("id", "up"), "moves")
    while True:  # a deleted parent's parent may be deleted too; each round doubles the steps
        ahead = moves.select(F.col("id").alias("up"), F.col("up").alias("next"), F.lit(True).alias("more"))
        step = scratch.cut(moves.join(ahead, "up", "left").select("id", F.when(F.col("more"), F.col("next")).otherwise(F.col("up")).alias("up"), F.col("more").isNotNull().alias("moved")), "moves")
        moves = step.select("id", "up")
        if step.where("moved").isEmpty():
            break
    to = moves.select(F.col("id").alias("parent_id"), F.col("up").alias("_to"), F.lit(True).alias("_gone"))
    out = blocks.join(to, "parent_id", "left").withColumn("parent_id", F.when(F.col("_gone"), F.col("_to")).otherwise(F.col("parent_id"))).drop("_to", "_gone")
    if "children_ids" not in blocks.columns:
        return out.select(blocks.columns)
    # the lists of parents that stay: without the deleted children, with those that moved up
    listed = blocks.select("id", F.posexplode("children_ids").alias("n", "child")).join(gone.select(F.col("id").alias("child")), "child", "left_anti")
    came = blocks.select(F.col("id").alias("child"), "parent_id").join(to.where("_to is not null"), "parent_id").join(gone.select(F.col("id").alias("child")), "child", "left_anti").select(F.col("_to").alias("id"), F.lit(1 << 30).alias("n"), "child")
    lists = listed.unionByName(came).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "child"))), lambda x: x["child"]).alias("_c"))
    out = out.join(lists, "id", "left").withColumn("children_ids", F.coalesce("_c", F.array().cast("array<string>")))
    return out.select(blocks.columns)


def soft_delete(tables: Tables, ids: DataFrame, scratch: Scratch, cascade: bool = False) -> Tables:
    """Flags records (with ``cascade`` all their descendants too, else these move up), drops their edges and vectors."""
    gone = ids.select("id").distinct()
    if cascade:
        nodes = scratch.cut(hierarchy.hierarchy(hierarchy.resolve_parents(tables.blocks, scratch), scratch), "nodes")
        pairs = hierarchy.descendants(nodes).select("v", "descendant").unionByName(hierarchy.endless_descendants(nodes, scratch))
        gone = gone.unionByName(pairs.join(gone.select(F.col("id").alias("v")), "v").select(F.col("descendant").alias("id"))).distinct()
    gone = scratch.cut(gone.join(tables.blocks.where(~F.coalesce("deleted", F.lit(False))).select("id"), "id", "left_semi"), "gone")
    blocks = tables.blocks if cascade else _reparented(tables.blocks, gone, scratch)
    flagged = blocks.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce("_gone", F.lit(False))).select(tables.blocks.columns)
    edges, embeddings = _without(tables, gone)
    return Tables(flagged, edges, embeddings, _logged(gone, "delete"))


def hard_delete(tables: Tables, ids: DataFrame, scratch: Scratch) -> Tables:
    """Removes records with their edges and vectors; what hung below them moves up."""
    gone = scratch.cut(ids.select("id").distinct().join(tables.blocks.select("id"), "id", "left_semi"), "gone")
    blocks = _reparented(tables.blocks, gone, scratch).join(gone, "id", "left_anti").select(tables.blocks.columns)
    edges, embeddings = _without(tables, gone)
    return Tables(blocks, edges, embeddings, _logged(gone, "delete", F.lit('{"hard": true}')))


def prune(tables: Tables, weak: DataFrame, scratch: Scratch) -> Tables:
    """Deletes the candidates ``id, reason`` of ``records.prune_candidates``; the reason is logged."""
    out = soft_delete(tables, weak.select("id"), scratch)
    return replace(out, operations=_logged(weak, "delete", F.to_json(F.struct("reason"))))


def move(tables: Tables, moves: DataFrame, scratch: Scratch) -> tuple[Tables, DataFrame]:
    """Gives records ``id`` the parent ``parent_id``; refused moves (``id, rule``) change nothing: unknown ids, types that do not fit, below themselves.

    Moves are judged against the tree as it was, so of a batch none may rely on another.
    """
    new = moves.groupBy("id").agg(F.min("parent_id").alias("_to"))
    live = tables.blocks.where(~F.coalesce("deleted", F.lit(False)))
    tried = new.join(live.drop("parent_id"), "id", "left").withColumn("parent_id", F.col("_to"))
    unknown = new.join(live.select("id"), "id", "left_anti").select("id", F.lit("record does not exist").alias("rule"))
    kinds = live.select(F.col("id").alias("parent_id"), F.col("type").alias("_type"))
    fits = F.lit(False)
    for kind, allowed in PARENTS.items():
        fits = fits | ((F.col("type") == kind) & F.col("_type").isin(allowed))
    judged = tried.where("type is not null and parent_id is not null").join(kinds, "parent_id", "left")
    wrong = judged.select("id", F.when(F.col("_type").isNull(), "parent does not exist").when(~F.coalesce(fits, F.lit(False)), "parent is of another type").alias("rule")).where("rule is not null")
    nodes = scratch.cut(hierarchy.hierarchy(hierarchy.resolve_parents(tables.blocks, scratch), scratch), "nodes")
    own = nodes.select(F.col("v").alias("id"), "root", "pre", "size")
    target = nodes.select(F.col("v").alias("_to"), F.col("root").alias("r2"), F.col("pre").alias("p2"))
    below = new.join(own, "id").join(target, "_to").where("root = r2 and p2 >= pre and p2 < pre + size").select("id", F.lit("parent is below the record").alias("rule"))
    refused = scratch.cut(unknown.unionByName(wrong).unionByName(below).distinct(), "refused")
    good = scratch.cut(new.join(refused.select("id"), "id", "left_anti"), "good")
    blocks = tables.blocks.join(good.withColumn("_hit", F.lit(True)), "id", "left").withColumn("parent_id", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("parent_id"))).drop("_to", "_hit")
    if "children_ids" in blocks.columns:
        listed = blocks.select("id", F.posexplode("children_ids").alias("n", "child")).join(good.select(F.col("id").alias("child")), "child", "left_anti")
        came = good.where("_to is not null").select(F.col("_to").alias("id"), F.lit(1 << 30).alias("n"), F.col("id").alias("child"))
        lists = listed.unionByName(came).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "child"))), lambda x: x["child"]).alias("_c"))
        blocks = blocks.join(lists, "id", "left").withColumn("children_ids", F.coalesce("_c", F.array().cast("array<string>"))).drop("_c")
    operations = _logged(good, "update", F.to_json(F.struct(F.col("_to").alias("parent_id"))))
    return replace(tables, blocks=blocks.select(tables.blocks.columns), operations=operations), refused


def write_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts vectors by ``block_id``; of equal ids in ``new`` the smallest vector is taken."""
    one = new.groupBy("block_id").agg(F.min("embedding").alias("embedding")).select(embeddings.columns)
    return embeddings.join(one.select("block_id"), "block_id", "left_anti").select(embeddings.columns).unionByName(one)


def delete_embeddings(embeddings: DataFrame, ids: DataFrame) -> DataFrame:
    return embeddings.join(ids.select("block_id").distinct(), "block_id", "left_anti").select(embeddings.columns)
