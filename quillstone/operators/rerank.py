"""Second passes over retrieved records: heuristic reranking, retrieval over several hops, pluggable rerankers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.wordlists import NO_KEYWORD, NO_NAME, entries
from quillstone.operators import entities, graph, retrieval
from quillstone.plans.scratch import Scratch


def _without(words: Column, excluded: str) -> Column:
    no = F.array(*[F.lit(w) for w in entries(excluded)])
    return F.filter(words, lambda w: ~F.array_contains(no, w))


def heuristic(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Place in the list, share of the query's keywords in the text, one of its quoted phrases, share of its names.

    ``candidates`` has ``query_id, id, rank, text``. Keywords (a repeated one counts again), phrases and names count where the text contains them.
    """
    text = F.col("text")
    keywords = _without(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z]{3,})\b"), 1), NO_KEYWORD)
    quoted = [F.regexp_extract_all(text, F.lit(f"{q}([^{q}]{{3,60}}){q}"), 1) for q in ("'", '"')]
    phrases = F.filter(F.transform(F.concat(*quoted), lambda p: F.lower(F.trim(p))), lambda p: F.length(p) >= 3)
    names = F.transform(_without(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]{2,15})\b"), 1)), NO_NAME), F.lower)
    asked = queries.select("query_id", keywords.alias("keywords"), phrases.alias("phrases"), names.alias("names"))
    joined = candidates.join(asked, "query_id").withColumn("low", F.lower("text"))
    within = lambda a: F.size(F.filter(a, lambda w: F.contains(F.col("low"), w)))
    share = lambda a: F.when(F.size(a) > 0, within(a) / F.size(a)).otherwise(0.0)
    base = 1 - (F.col("rank") - 1) / F.count("*").over(Window.partitionBy("query_id"))
    score = base + 0.50 * share("keywords") + F.when(within("phrases") > 0, 0.60).otherwise(0.0) + 0.20 * share("names")
    scored = joined.select("query_id", "id", "rank", F.round(score, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "id")
    return scored.select("query_id", "id", "score", F.row_number().over(order).alias("rank"))


def by_function(candidates: DataFrame, rerank: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Scores from a caller's function of one query's candidates at a time (a bounded list per query)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[["query_id", "id"]].assign(score=rerank(pdf).astype("float64"))

    kinds = dict(candidates.dtypes)
    scored = candidates.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    return retrieval.ranked(scored)


def multi_hop(queries: DataFrame, records: DataFrame, live: DataFrame, scratch: Scratch, limit: int = 10) -> DataFrame:
    """``query_id, id, hop, score, rank``: keyword results, results for the entities of question and results, then the graph around all of them.

    ``records`` has ``id, text, type, strength``, ``live`` the edges ``a, b``. A question without results is asked by its first three entities instead. The ten entities
    asked are those of the question, then those of the results, each in order of appearance. Each id counts at its first hop.
    """
    texts = records.select("id", "text")
    mine = scratch.cut(queries.select("query_id", F.posexplode(entities.of_question(F.col("text"))).alias("k", "entity")), "mine")
    one = lambda base: F.lit(base) + 1 / F.col("rank") + F.coalesce("strength", F.lit(0.0)) * 0.05
    strength = records.select("id", "strength")

    def asked(rows: DataFrame, hop: int) -> DataFrame:
        """``rows``: query_id, k, entity, base."""
        key = F.concat_ws("#", F.col("query_id").cast("string"), "k")
        keyed = scratch.cut(rows.withColumn("key", key), "asked")
        found = retrieval.keyword_search(keyed.select(F.col("key").alias("query_id"), F.col("entity").alias("text")), texts, limit, scratch=scratch)
        found = found.withColumnRenamed("query_id", "key").join(keyed, "key").join(strength, "id")
        first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("k", "rank"))
        return found.withColumn("_n", first).where("_n = 1").select("query_id", "id", F.lit(hop).alias("hop"), (F.col("base") + 1 / F.col("rank") + F.col("strength") * 0.05).alias("score"))

    first = scratch.cut(retrieval.keyword_search(queries, texts, 3 * limit, scratch=scratch), "first")
    hop1 = first.join(strength, "id").select("query_id", "id", F.lit(1).alias("hop"), one(2.0).alias("score"))
    bare = queries.select("query_id").join(first.select("query_id"), "query_id", "left_anti")
    hop1 = scratch.cut(hop1.unionByName(asked(mine.join(bare, "query_id").where("k < 3").withColumn("base", F.lit(1.5)), 1)), "hop1")
    theirs = first.join(records.select("id", "text", "type"), "id").select("query_id", "rank", F.posexplode(entities.of_record(F.col("text"), F.col("type"))).alias("k", "entity"))
    every = mine.select("query_id", F.lit(0).alias("rank"), "k", "entity").unionByName(theirs)
    known = every.groupBy("query_id", F.lower("entity").alias("low")).agg(F.min(F.struct("rank", "k", "entity")).alias("x")).join(hop1.select("query_id").distinct(), "query_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("x.rank", "x.k", "low"))
    ten = known.withColumn("k", place).where("k <= 10").select("query_id", "k", F.col("x.entity").alias("entity"), F.when(F.col("x.rank") == 0, 1.0).otherwise(0.7).alias("base"))
    hop2 = asked(ten, 2).join(hop1.select("query_id", "id"), ["query_id", "id"], "left_anti")
    found = scratch.cut(hop1.unionByName(hop2), "found")
    walked = graph.traverse(found.select("id").distinct(), live, scratch, 3)
    near = found.select("query_id", F.col("id").alias("start")).join(walked, "start").groupBy("query_id", "id").agg(F.min("depth").alias("depth"))
    near = near.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").join(strength, "id")
    hop3 = near.select("query_id", "id", F.lit(3).alias("hop"), (F.col("strength") + 0.4 / F.col("depth")).alias("score"))
    scored = found.unionByName(hop3).select("query_id", "id", "hop", F.round("score", 6).alias("score"))
    return retrieval.ranked(scored, limit)
