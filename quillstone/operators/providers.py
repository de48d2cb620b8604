"""Steps whose judgement comes from a caller: classification, conflicts, extraction, lessons. The callers' functions run in Arrow batches.

A function gets a pandas Series of texts and returns one of JSON answers; an answer that cannot be read counts as none, so that a failing model never loses a record.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.operators import retrieval

Model = Callable[[pd.Series], pd.Series]
# What may be decided about a new record.
DECISIONS = ["ADD", "UPDATE", "DELETE", "RETRACT", "NONE"]
#: Experiences taken from one answer, and their confidence.
LESSONS, LESSON_CONFIDENCE = 3, 0.8


def answers(model: Model, prompt: Column) -> Column:
    """The model's answers; null where it raised."""

    def run(texts: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(texts)).astype(object)
        except Exception:  # noqa: BLE001 - a caller's model may fail in any way
            return pd.Series([None] * len(texts), dtype=object)

    return F.pandas_udf(run, T.StringType())(prompt)


def json_body(answer: Column) -> Column:
    """An answer without the fence that models put around JSON."""
    return F.trim(F.regexp_replace(answer, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def classify(records: DataFrame, model: Model, skip: Column | None = None) -> DataFrame:
    """Fills ``type, tags, confidence`` where they are null from answers ``{"type", "tags", "confidence", "escalate"}``; adds ``classified`` (the answer) and ``escalate``."""
    fields = "type string, tags array<string>, confidence double, escalate boolean"
    prompt = F.col("content") if skip is None else F.when(~F.coalesce(skip, F.lit(False)), F.col("content"))
    read = records.withColumn("classified", json_body(answers(model, prompt))).withColumn("_c", F.from_json("classified", fields))
    for name in ("type", "tags", "confidence"):
        read = read.withColumn(name, F.coalesce(name, F.col("_c")[name]))
    return read.withColumn("type", F.coalesce("type", F.lit("fact"))).withColumn("escalate", F.coalesce(F.col("_c")["escalate"], F.lit(False))).drop("_c")


def decide(new: DataFrame, known: DataFrame, model: Model, top: int = 5) -> DataFrame:
    """``id, decision, target_id, content`` for new records ``id, type, content, vector`` against their ``top`` nearest of ``known``.

    The model is asked once per record with the record and its neighbours as JSON and answers a list of ``{"action", "block_id", "content"}``.
    Actions on records that were not shown, and changes of records of another type, are dropped; without a valid action a record is added.
    """
    near = retrieval.vector_search(new.select(F.col("id").alias("query_id"), "vector"), known.select("id", "vector"), top + 1).where(F.col("query_id") != F.col("id")).where(F.col("rank") <= top + 1)
    shown = near.select(F.col("query_id").alias("id"), F.col("id").alias("target_id"), "rank").join(known.select(F.col("id").alias("target_id"), F.col("type").alias("target_type"), F.col("content").alias("target_content")), "target_id")
    first = F.row_number().over(Window.partitionBy("id").orderBy("rank", "target_id"))
    shown = shown.withColumn("_n", first).where(F.col("_n") <= top)
    context = shown.groupBy("id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("target_id").alias("block_id"), F.col("target_content").alias("content")))), lambda x: F.struct(x["block_id"].alias("block_id"), x["content"].alias("content")))).alias("similar"))
    asked = new.select("id", "type", "content").join(context, "id", "left")
    prompt = F.when(F.col("similar").isNotNull(), F.to_json(F.struct("content", "similar")))
    read = F.from_json(json_body(answers(model, prompt)), "array<struct<action: string, block_id: string, content: string>>")
    each = asked.select("id", F.col("type").alias("_type"), F.explode_outer(read).alias("a")).select("id", "_type", F.upper("a.action").alias("decision"), F.col("a.block_id").alias("target_id"), F.col("a.content").alias("content"))
    judged = each.where(F.col("decision").isin(DECISIONS)).join(shown.select("id", "target_id", "target_type"), ["id", "target_id"], "left")
    whole = F.col("decision").isin("ADD", "NONE")
    valid = judged.where(whole | (F.col("target_type").isNotNull() & (F.col("target_type") == F.col("_type"))))
    valid = valid.select("id", "decision", F.when(~whole, F.col("target_id")).alias("target_id"), "content").distinct()
    rest = new.select("id").join(valid.select("id"), "id", "left_anti").select("id", F.lit("ADD").alias("decision"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("content"))
    return valid.unionByName(rest)


def extract(texts: DataFrame, model: Model, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """From ``id, text``: records ``id, source, type, content, confidence, tags``, and relations between them as edges by their content.

    Answers are lists of ``{"type", "content", "confidence", "tags", "relations": [{"target", "relation"}]}``; a relation's target is the content of another record of the same text.
    """
    shape = "array<struct<type: string, content: string, confidence: double, tags: array<string>, relations: array<struct<target: string, relation: string>>>>"
    each = texts.select(F.col("id").alias("source"), F.explode(F.from_json(json_body(answers(model, F.col("text"))), shape)).alias("x")).select("source", "x.*")
    good = each.where((F.trim(F.coalesce("content", F.lit(""))) != "") & (F.coalesce("confidence", F.lit(1.0)) >= least))
    name = F.concat(F.lit("blk_"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("source").cast("string"), "content"), 256), 1, 12))
    good = good.withColumn("id", name).dropDuplicates(["id"])
    wanted = good.select("source", F.col("id").alias("source_id"), F.explode("relations").alias("r")).select("source", "source_id", F.col("r.target").alias("content"), F.col("r.relation").alias("relation"))
    edges = wanted.join(good.select("source", "content", F.col("id").alias("target_id")), ["source", "content"]).where("source_id <> target_id").select("source_id", "target_id", F.coalesce("relation", F.lit("related_to")).alias("relation")).distinct()
    return good.select("id", "source", F.coalesce("type", F.lit("fact")).alias("type"), "content", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "tags"), edges


def experience_text(when: Column, do: Column, verify: Column) -> Column:
    """An experience as content; what is null is left out."""
    part = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    return F.concat_ws("\n", part("When", when), part("Do", do), part("Verify", verify))


def experiences(rows: DataFrame) -> DataFrame:
    """``when, do, verify`` rows as records of type ``experience``; rows without ``when`` or ``do`` are none."""
    good = rows.where((F.trim(F.coalesce("when", F.lit(""))) != "") & (F.trim(F.coalesce("do", F.lit(""))) != "")).withColumn("content", experience_text(F.col("when"), F.col("do"), F.col("verify")))
    meta = F.to_json(F.struct(F.col("when").alias("_when"), F.col("do").alias("_do"), F.col("verify").alias("_verify")))
    out = good.select(F.concat(F.lit("blk_"), F.substring(F.sha2("content", 256), 1, 12)).alias("id"), F.lit("experience").alias("type"), "content", F.lit(LESSON_CONFIDENCE).alias("confidence"), meta.alias("custom_metadata"))
    return out.dropDuplicates(["id"])


def learn(tasks: DataFrame, model: Model) -> DataFrame:
    """Experiences from finished tasks ``id, text``: the first ``LESSONS`` of each answer, a list of ``{"when", "do", "verify"}``."""
    read = F.from_json(json_body(answers(model, F.col("text"))), "array<struct<when: string, do: string, verify: string>>")
    return experiences(tasks.select(F.explode(F.slice(read, 1, LESSONS)).alias("x")).select("x.when", "x.do", "x.verify"))
