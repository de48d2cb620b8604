"""Snapshots: a folder of Parquet tables with a stamp of counts and a checksum; Markdown export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("blocks", "edges", "embeddings", "operations")
#: The columns of an empty store.
SCHEMAS = {
    "blocks": "id string, user_id string, type string, content string, tags array<string>, parent_id string, children_ids array<string>, version int, op_hash string, content_hash string, deleted boolean, encryption_level string, encrypted boolean, confidence double, source string, created_at timestamp, created_by string, access_count int, last_accessed timestamp, decay_rate double, ttl int, session_id string, org_id string, project_id string, agent_id string, custom_metadata string, happened_at timestamp, happened_at_end timestamp, temporal_precision string",
    "edges": "id string, source_id string, target_id string, relation string, weight double, created_at timestamp",
    "operations": "id string, block_id string, author string, clock bigint, action string, data string, hash string, prev_hash string, timestamp timestamp",
    "embeddings": "block_id string, embedding array<float>",
}


def checksum(df: DataFrame) -> tuple[int, int, int]:
    """Rows, and sums of two hashes of every row: the order of rows does not matter."""
    columns = [F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(df.columns)]
    h = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(2**40))).alias(f"h{seed}")
    n, a, b = df.agg(F.count("*").alias("n"), h(1), h(2)).first()
    return n, a or 0, b or 0


def write(folder: str, blocks: DataFrame, edges: DataFrame, embeddings: DataFrame, operations: DataFrame) -> None:
    """Writes the blocks, edges with both ends among them, their vectors and operations, and then the stamp."""
    spark = blocks.sparkSession
    ids = blocks.select("id").distinct()
    inside = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    of = ids.select(F.col("id").alias("block_id"))
    tables = {"blocks": blocks, "edges": inside, "embeddings": embeddings.join(of, "block_id", "left_semi"), "operations": operations.join(of, "block_id", "left_semi")}
    stamp = []
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        stamp.append((name, *checksum(spark.read.parquet(f"{folder}/{name}"))))
    spark.createDataFrame(stamp, "name string, n bigint, h1 bigint, h2 bigint").coalesce(1).write.json(f"{folder}/stamp")


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot; a ``ValueError`` names a table that does not match its stamp."""
    out = {}
    for r in spark.read.json(f"{folder}/stamp").collect():
        df = spark.read.parquet(f"{folder}/{r['name']}")
        if checksum(df) != (r["n"], r["h1"], r["h2"]):
            raise ValueError(f"{r['name']} does not match its stamp")
        out[r["name"]] = df
    return out


def restore(current: dict[str, DataFrame], snapshot: dict[str, DataFrame], mode: str = "merge", embeddings: str = "strict", models: tuple[str | None, str | None] = (None, None), reembed: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Adds a snapshot's blocks whose ids are new, their edges to known blocks, and what belongs to them.

    ``mode`` ``empty`` demands a store without blocks. ``models`` names the embedding models of store and snapshot: if both are known and differ,
    ``embeddings`` decides: ``strict`` refuses, ``drop`` leaves the vectors out, ``reembed`` makes ``block_id, embedding`` anew from ``id, content``.
    """
    if mode not in ("empty", "merge") or embeddings not in ("strict", "drop", "reembed"):
        raise ValueError("mode is empty or merge; embeddings is strict, drop or reembed")
    if mode == "empty" and not current["blocks"].isEmpty():
        raise ValueError("the store is not empty")
    differ = None not in models and models[0] != models[1]
    if differ and embeddings == "strict":
        raise ValueError(f"vectors of {models[1]} do not fit a store of {models[0]}")
    new = snapshot["blocks"].join(current["blocks"].select("id"), "id", "left_anti").select(current["blocks"].columns)
    blocks = current["blocks"].unionByName(new)
    added, known = new.select(F.col("id").alias("block_id")).distinct(), blocks.select(F.col("id").alias("target_id")).distinct()
    edges = snapshot["edges"].join(added.select(F.col("block_id").alias("source_id")), "source_id", "left_semi").join(known, "target_id", "left_semi")
    edges = edges.join(current["edges"].select("id"), "id", "left_anti").select(current["edges"].columns)
    out = {"blocks": blocks, "edges": current["edges"].unionByName(edges)}
    for name in ("embeddings", "operations"):
        rows = snapshot[name].join(added, "block_id", "left_semi").select(current[name].columns)
        if name == "embeddings" and differ:
            rows = reembed(new.select("id", "content")).select(current[name].columns) if embeddings == "reembed" and reembed else rows.limit(0)
        out[name] = current[name].unionByName(rows)
    return out


def merge(current: dict[str, DataFrame], snapshot: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``restore`` into whatever is there."""
    return restore(current, snapshot)


def markdown(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, text``: a header, the fields and the edges of every record, outgoing and incoming, each edge once."""
    good = edges.where("source_id <> '' and target_id <> ''").select("source_id", "target_id", "relation").distinct()
    out = good.select(F.col("source_id").alias("id"), F.concat(F.lit("- "), "relation", F.lit(" -> "), "target_id").alias("arrow"))
    into = good.select(F.col("target_id").alias("id"), F.concat(F.lit("- "), "relation", F.lit(" <- "), "source_id").alias("arrow"))
    # a record's text lists all its edges by definition: only ids of blocks that are exported are gathered
    lists = out.unionByName(into).join(blocks.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("arrow")), "\n").alias("links"))
    head = F.format_string("## %s (%s)\n\n%s\n\nconfidence: %.2f, tags: %s\n", F.col("id"), F.col("type"), F.coalesce("content", F.lit("")), F.coalesce("confidence", F.lit(1.0)), F.concat_ws(", ", "tags"))
    return blocks.join(lists, "id", "left").select("id", F.concat(head, F.coalesce("links", F.lit(""))).alias("text"))
