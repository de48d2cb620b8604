"""Records: one row per id, filters, lifecycle, statistics, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scalars


def latest(blocks: DataFrame) -> DataFrame:
    """One row per id: the most accessed, then the last accessed."""
    w = Window.partitionBy("id").orderBy(F.desc("access_count"), F.desc_nulls_last("last_accessed"))
    return blocks.where("id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep(
    blocks: DataFrame, *, type: str | None = None, parent_id: str | None = None, min_confidence: float = 0.0, tags: list[str] | None = None, scopes: dict[str, str] | None = None,
    metadata: dict[str, object] | None = None, happened_after: object = None, happened_before: object = None, include_deleted: bool = False,
) -> DataFrame:
    """All conditions hold; tags match if any is shared; metadata compares as text; times are inclusive."""
    conditions: list[Column] = [] if include_deleted else [~F.coalesce("deleted", F.lit(False))]
    for name, value in {"type": type, "parent_id": parent_id, **(scopes or {})}.items():
        if value is not None:
            conditions.append(F.col(name) == value)
    if min_confidence > 0:
        conditions.append(F.col("confidence") >= min_confidence)
    if tags:
        conditions.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    for key, value in (metadata or {}).items():
        conditions.append(F.get_json_object("custom_metadata", f"$.{key}") == str(value))
    if happened_after is not None:
        conditions.append(F.col("happened_at") >= F.lit(happened_after).cast("timestamp"))
    if happened_before is not None:
        conditions.append(F.col("happened_at") <= F.lit(happened_before).cast("timestamp"))
    for c in conditions:
        blocks = blocks.where(c)
    return blocks


def with_strength(blocks: DataFrame, as_of: str) -> DataFrame:
    """Adds ``strength``, to 6 decimals."""
    now = F.lit(as_of).cast("timestamp")
    rate = F.coalesce("decay_rate", scalars.default_rate(F.col("type")))
    value = scalars.strength(F.coalesce("confidence", F.lit(1.0)), rate, F.col("created_at"), F.coalesce("access_count", F.lit(0)), F.col("last_accessed"), now)
    return blocks.withColumn("strength", F.round(value, 6))


def prune_candidates(blocks: DataFrame, as_of: str, threshold: float = 0.1) -> DataFrame:
    """Live records past their time to live, else too weak: ``id, reason``."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("created_at")) / 1e6
    reason = F.when(age > F.col("ttl"), "expired").when(F.col("strength") < threshold, "weak")
    return with_strength(keep(blocks), as_of).select("id", reason.alias("reason")).where("reason is not null")


def touch(blocks: DataFrame, accesses: DataFrame) -> DataFrame:
    """Counts ``id, at`` access events into the records."""
    new = accesses.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    joined = blocks.join(new, "id", "left")
    return joined.withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0)).cast("int")).withColumn("last_accessed", F.greatest("last_accessed", "_at")).drop("_n", "_at")


def upsert(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Whole rows by id; the higher version wins, changes win ties."""
    both = blocks.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("version"), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def violations(blocks: DataFrame) -> DataFrame:
    """``id, rule`` of every broken rule."""
    rules = {
        "content is empty": F.trim(F.coalesce("content", F.lit(""))) == "", "confidence outside 0 to 1": ~F.col("confidence").between(0, 1),
        "decay rate below 0": F.col("decay_rate") < 0, "time to live not positive": F.col("ttl") <= 0, "empty tag": F.exists("tags", lambda t: t.isNull() | (F.trim(t) == "")),
        "ends before it began": F.col("happened_at_end") < F.col("happened_at"),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return blocks.select("id", F.explode(broken).alias("rule"))


def statistics(blocks: DataFrame, edges: DataFrame, operations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``metric, value``: live and deleted records, live ones by type, edges, operations, vectors."""
    gone = F.coalesce("deleted", F.lit(False))
    state = blocks.groupBy(F.when(gone, F.lit("deleted")).otherwise(F.concat(F.lit("live "), F.coalesce("type", F.lit("?")))).alias("metric")).agg(F.count("*").alias("value"))
    others = [df.agg(F.count_distinct(c).alias("value")).select(F.lit(n).alias("metric"), "value") for n, df, c in (("edges", edges, "id"), ("operations", operations, "id"), ("embeddings", embeddings, "block_id"))]
    out = state
    for o in others:
        out = out.unionByName(o)
    return out


def sequential_links(blocks: DataFrame, weight: float = 0.8) -> DataFrame:
    """Each record of a session linked to the one before it."""
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return blocks.where("session_id is not null").select(F.col("id").alias("source_id"), F.lag("id").over(w).alias("target_id"), F.lit(weight).alias("weight")).where("target_id is not null")


def chunks(documents: DataFrame, id_col: str, text_col: str, most: int = 2000) -> DataFrame:
    """Texts split at blank lines and put together again to pieces of at most ``most`` characters: ``id, n, chunk``."""
    paragraphs = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda p: F.trim(p) != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = F.length(acc["open"]) + F.length(p) + 2 <= most
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        return F.when(fits | (acc["open"] == ""), F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")))

    whole = F.aggregate(paragraphs, empty, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return documents.select(F.col(id_col).alias("id"), F.posexplode(whole).alias("n", "chunk"))
