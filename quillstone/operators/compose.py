"""The composed query: filters, keywords, vectors, time windows, graph proximity and decay in one ranking, for many queries at once.

Queries are a stated set ``query_id, text`` with, where wanted, ``vector`` (the embedded text) and ``related_to`` (an id). Per query:

1. A time phrase in the text gives a window on ``happened_at`` and a text without it.
2. Records that pass all filters and match any word are ranked by BM25 over all live records, newest first among equals; the best ``pool`` are candidates. If
   weak records in the pool leave too few, all matches are (never renumbered).
3. With a vector, reciprocal ranks of candidates and vectors are added up, plus a share of the cosine for every vector; of the merged
   list the best ``pool`` come in, if they pass the filters. Without one, the place among the candidates counts.
4. Relevance adds confidence, strength, recency and the distance in the graph from ``related_to``; its neighbours are candidates where there are no others.
5. The window prefers (``rank``: the ranking inside and the whole one are merged turn by turn) or filters (``filter``, and every other order
   than by relevance) unless nothing is inside.

Defined results: a query without words, vector or neighbours finds nothing; null texts find by vector only; an id counts once per
query; ties end in the id; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import phrases, scalars
from quillstone.operators import graph, records, retrieval
from quillstone.plans.scratch import Scratch

ORDERS = {"relevance": "score", "recency": "created_at", "access_count": "access_count", "strength": "strength"}
#: Weights of the merged list, and the share of the best sum that a cosine of 1 adds.
KEYWORD, VECTOR, BONUS, NEAR = 0.4, 0.6, 0.5, 0.3


def searched_text(blocks: DataFrame) -> DataFrame:
    """``id, text, created_at``: content and tags, as keywords find them."""
    return blocks.select("id", F.concat_ws(" ", "content", "tags").alias("text"), "created_at")


def _within(c: Column, after: Column, before: Column) -> Column:
    return F.coalesce((after.isNull() | (c >= after)) & (before.isNull() | (c <= before)) & c.isNotNull(), F.lit(False))


def search(
    queries: DataFrame, blocks: DataFrame, as_of: str, scratch: Scratch, *, edges: DataFrame | None = None, embeddings: DataFrame | None = None, limit: int = 10, sort_by: str = "relevance",
    include_decayed: bool = False, min_strength: float = 0.0, time_window: str = "rank", stemmed: bool = True, **filters: object,
) -> DataFrame:
    """``query_id, id, rank, relevance, strength``; ``filters`` are those of ``records.keep``, ``embeddings`` has ``block_id, embedding``."""
    if sort_by not in ORDERS or time_window not in ("rank", "filter"):
        raise ValueError("sort_by is relevance, recency, access_count or strength; time_window is rank or filter")
    pool, now, have = max(5 * limit, 50), F.lit(as_of).cast("timestamp"), set(queries.columns)
    semantic = embeddings is not None and "vector" in have
    w = phrases.time_window(F.col("text"), now)
    q = queries.select("query_id", F.coalesce(w["text"], F.col("text")).alias("text"), w["after"].alias("after"), w["before"].alias("before"), *[c for c in ("vector", "related_to") if c in have])
    q = scratch.cut(q, "queries")
    live = records.keep(blocks)
    facts = scratch.cut(records.with_strength(records.keep(blocks, **filters), as_of).select("id", "type", "content", "confidence", "strength", "created_at", "access_count", "happened_at"), "facts")
    scored = retrieval.keyword_scores(q.where("text is not null"), searched_text(live), stemmed, scratch)
    windows = q.select("query_id", "after", "before", (F.col("after").isNotNull() | F.col("before").isNotNull()).alias("windowed"))
    brief = facts.drop("content", "type")
    matches = scored.join(brief, "id").join(windows, "query_id").withColumn("inside", F.col("windowed") & _within(F.col("happened_at"), F.col("after"), F.col("before")))
    matches = scratch.cut(matches, "matches")
    strong = F.lit(True) if include_decayed else F.col("strength") >= min_strength

    def candidates(rows: DataFrame) -> DataFrame:
        """Rows with their place ``r`` and whether they are ``kept`` as strong enough."""
        per = Window.partitionBy("query_id")
        order = per.orderBy(F.desc(ORDERS[sort_by]), F.desc_nulls_last("created_at"), "id")
        rows = rows.withColumn("r", F.row_number().over(order)).withColumn("kept", strong)
        if sort_by == "strength":
            return rows
        left = F.sum(F.when((F.col("r") <= pool) & F.col("kept"), 1).otherwise(0)).over(per)
        starved = F.lit(min_strength > 0 and not include_decayed) & (F.count("*").over(per) >= pool) & (left < limit)
        return rows.withColumn("starved", starved).where((F.col("r") <= pool) | F.col("starved")).drop("starved")

    whole, relaxed = sort_by == "relevance" and time_window == "rank", None
    if whole:
        lists = {"overall": candidates(matches), "inside": candidates(matches.where("inside"))}
    else:
        some = F.max("inside").over(Window.partitionBy("query_id"))
        relaxed = matches.withColumn("some", some).where("not windowed or inside or not some")
        lists = {"overall": candidates(relaxed)}
    lists = {name: scratch.cut(rows, name) for name, rows in lists.items()}
    vectors = None
    if semantic:
        known = embeddings.select(F.col("block_id").alias("id"), F.col("embedding").alias("vector")).join(live.select("id"), "id", "left_semi")
        asked = q.where("vector is not null").select("query_id", "vector")
        pairs = lists["overall"].select("query_id", "id")
        for rows in lists.values():
            pairs = pairs.unionByName(rows.select("query_id", "id"))
        top = retrieval.vector_search(asked, known, pool)
        vectors = scratch.cut(top.unionByName(retrieval.vector_ranks(asked, known, pairs).select(top.columns)).distinct(), "vectors")
    near = None
    if edges is not None and "related_to" in have:
        starts = q.where("related_to is not null").select(F.col("related_to").alias("id")).distinct()
        depths = graph.traverse(starts, scratch.cut(graph.live_edges(edges, blocks), "live"), scratch, 3)
        near = scratch.cut(q.select("query_id", F.col("related_to").alias("start")).join(depths, "start").select("query_id", "id", (NEAR / F.col("depth")).alias("near")), "near")

    def ranking(rows: DataFrame, windowed: bool) -> DataFrame:
        plain = rows.select("query_id", "id", (F.lit(4.0) / (3 + F.col("r"))).alias("sem"))
        found = rows.where("kept").select("query_id", "id")
        if vectors is not None:
            own = rows.join(q.where("vector is not null").select("query_id"), "query_id", "left_semi")
            merged = retrieval.rrf(own.where(F.col("r") <= pool).select("query_id", "id", F.col("r").alias("rank")), vectors, keyword_weight=KEYWORD, vector_weight=VECTOR, bonus=BONUS)
            merged = scratch.cut(merged, "merged")
            sem = retrieval.normalise(merged.select("query_id", "id", "score")).withColumnRenamed("score", "sem")
            by_vector = sem.select("query_id").distinct()
            extra = merged.where(F.col("rank") <= pool).join(rows.where("kept").select("query_id", "id"), ["query_id", "id"], "left_anti").join(brief, "id").join(windows, "query_id").where(strong)
            if windowed:
                extra = extra.where(_within(F.col("happened_at"), F.col("after"), F.col("before")) & F.col("windowed"))
            found = found.unionByName(extra.select("query_id", "id")).distinct()
            plain = sem.unionByName(plain.join(by_vector, "query_id", "left_anti"))
        if near is not None:
            bare = near.join(rows.select("query_id").distinct(), "query_id", "left_anti").join(brief, "id").where(strong)
            if windowed:
                bare = bare.join(windows, "query_id").where(_within(F.col("happened_at"), F.col("after"), F.col("before")) & F.col("windowed"))
            found = found.unionByName(bare.select("query_id", "id")).distinct()
        out = found.join(plain, ["query_id", "id"], "left").join(brief, "id")
        out = out.join(near, ["query_id", "id"], "left") if near is not None else out.withColumn("near", F.lit(0.0))
        value = retrieval.relevance(F.coalesce("sem", F.lit(0.0)), F.coalesce("confidence", F.lit(1.0)), F.col("strength"), scalars.recency(F.col("created_at"), now), F.coalesce("near", F.lit(0.0)))
        out = out.withColumn("relevance", value)
        by = "relevance" if sort_by == "relevance" else ORDERS[sort_by]
        order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(by), "id")
        return out.select("query_id", "id", "relevance", "strength", F.row_number().over(order).alias("rank"))

    overall = scratch.cut(ranking(lists["overall"], False), "ranked")
    if not whole:
        return overall.where(F.col("rank") <= limit).select("query_id", "id", "rank", "relevance", "strength")
    inside = ranking(lists["inside"], True)
    merged = retrieval.interleave(inside.where(F.col("rank") <= limit), overall.where(F.col("rank") <= limit)).where(F.col("rank") <= limit)
    values = overall.unionByName(inside).groupBy("query_id", "id").agg(F.max("relevance").alias("relevance"), F.max("strength").alias("strength"))
    return merged.join(values, ["query_id", "id"]).select("query_id", "id", "rank", "relevance", "strength")
