"""Queries of the retrieval engine over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import phrases, scalars
from quillstone.functions.wordlists import NOISE, entries
from quillstone.operators import compose, context, dedup, entities, graph, lifecycle, links, oplog, questions, records, rerank, retrieval, session, trouble
from quillstone.operators.components import components
from quillstone.plans.problems import _PARENTS
from quillstone.plans.scratch import Scratch
from quillstone.sources.tables import table

AS_OF, EVENTS_AS_OF = "2025-09-01 00:00:00", "2024-01-31 00:00:00"
#: A stated set of keyword queries.
TEXTS = [("q1", "which sensor reads the latency scale"), ("q2", "budget rose while monitor fell below the limit"), ("q3", "gateway cached near the station"), ("q4", "umbrella voucher key expires")]


#: One SQL expression for both engines.
_QUESTION = """CASE event_id % 9 WHEN 0 THEN 'How do I undo a ' || event_type || '?' WHEN 1 THEN '  HOW do I   undo a ' || upper(event_type) || '?!' WHEN 2 THEN 'Cafe\u0301 ' || event_type
  WHEN 3 THEN 'Caf\u00e9 ' || event_type || '...' WHEN 4 THEN 'Thanks!' WHEN 5 THEN 'ok' WHEN 6 THEN 'Sure.' WHEN 7 THEN 'test' ELSE event_type END"""


#: Time phrases, as one SQL expression for both engines.
_PHRASE = """'About ' || CASE event_id % 12 WHEN 0 THEN 'yesterday' WHEN 1 THEN 'today' WHEN 2 THEN 'last month' WHEN 3 THEN (event_id % 50) || ' weeks ago' WHEN 4 THEN 'recently' WHEN 5 THEN 'in march' WHEN 6 THEN 'in December 2023'
  WHEN 7 THEN 'in 2022' WHEN 8 THEN 'before June 2024' WHEN 9 THEN 'after 2024' WHEN 10 THEN 'last Tuesday' ELSE 'nothing' END || ' and ' || event_type"""


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return records.latest(table(spark, folder, "blocks"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Events as questions, in several ways of writing each, and greetings."""
    e = table(spark, folder, "events")
    return e.select(F.concat(F.lit("org_"), F.col("user_id") % 5).alias("org_id"), F.expr(_QUESTION).alias("question"), "user_id", F.col("ts").cast("timestamp").alias("asked_at"))


def _queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "query_id string, text string")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Content and tags of the live records, as keywords find them."""
    return compose.searched_text(records.keep(_blocks(spark, folder))).drop("created_at")


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the rows whose vec_id is divisible by 20, against all rows."""
    e = table(spark, folder, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def filter_scope(spark: SparkSession, folder: str) -> DataFrame:
    found = records.keep(_blocks(spark, folder), type="fact", min_confidence=0.5, scopes={"org_id": "org_main"})
    return found.select("id", "confidence", "project_id")


def filter_tags_any(spark: SparkSession, folder: str) -> DataFrame:
    """Live records that share a tag with the records of org_main."""
    blocks = _blocks(spark, folder)
    wanted = blocks.where("org_id = 'org_main'").select(F.explode("tags").alias("tag")).distinct()
    tagged = records.keep(blocks).select("id", F.explode("tags").alias("tag"))
    return tagged.join(wanted, "tag", "left_semi").select("id").distinct()


def filter_metadata_json(spark: SparkSession, folder: str) -> DataFrame:
    return records.keep(_blocks(spark, folder), metadata={"ver": 19}).select("id", "custom_metadata")


def filter_happened(spark: SparkSession, folder: str) -> DataFrame:
    return records.keep(_blocks(spark, folder), happened_after="2024-06-01", happened_before="2025-03-01").select("id", "happened_at")


def decay_strength(spark: SparkSession, folder: str) -> DataFrame:
    return records.with_strength(records.keep(_blocks(spark, folder)), AS_OF).select("id", F.round("strength", 4).alias("strength"))


def strongest_topk(spark: SparkSession, folder: str) -> DataFrame:
    s = records.with_strength(records.keep(_blocks(spark, folder)), AS_OF)
    return s.select("id", F.round("strength", 4).alias("strength")).orderBy(F.desc("strength"), "id").limit(50)


def prune_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return records.prune_candidates(_blocks(spark, folder), AS_OF)


def record_violations(spark: SparkSession, folder: str) -> DataFrame:
    return records.violations(_blocks(spark, folder))


def store_stats(spark: SparkSession, folder: str) -> DataFrame:
    return records.statistics(_blocks(spark, folder), *[table(spark, folder, t) for t in ("edges", "operations", "block_embeddings")])


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Every session with its records, oldest and newest."""
    live = records.keep(_blocks(spark, folder)).where("session_id is not null")
    return live.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("first_id"), F.max_by("id", F.struct("created_at", "id")).alias("last_id"))


def session_history(spark: SparkSession, folder: str) -> DataFrame:
    """The newest 5 records of every session, oldest first."""
    live = records.keep(_blocks(spark, folder)).where("session_id is not null")
    newest = live.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")))).where("n <= 5")
    return newest.select("session_id", "id", F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id")).alias("place"))


def sequential_links(spark: SparkSession, folder: str) -> DataFrame:
    return records.sequential_links(records.keep(_blocks(spark, folder)))


def question_counters(spark: SparkSession, folder: str) -> DataFrame:
    return questions.counters(_asked(spark, folder))


def question_top(spark: SparkSession, folder: str) -> DataFrame:
    return questions.top(_asked(spark, folder)).select("org_id", "rank", "question", "frequency", "n_users")


def question_top_windowed(spark: SparkSession, folder: str) -> DataFrame:
    return questions.top(_asked(spark, folder), since="2024-01-10", until="2024-01-20").select("org_id", "rank", "question", "frequency", "n_users", "lifetime")


def question_trending(spark: SparkSession, folder: str) -> DataFrame:
    return questions.trending(_asked(spark, folder), EVENTS_AS_OF)


def question_breakdown(by: str):  # noqa: ANN201
    return lambda spark, folder: questions.breakdown(_asked(spark, folder), by)


def question_stats(spark: SparkSession, folder: str) -> DataFrame:
    return questions.stats(_asked(spark, folder))


def question_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return questions.rollup(_asked(spark, folder))


def trouble_runs(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    return questions.trouble(calls, "user_id", ["ts", "event_id"], "failed", 2).select("event_id", "user_id", "run_length")


def content_hash_dups(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicates(_blocks(spark, folder))


def dedup_merge(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.merged(_blocks(spark, folder)).select("hash", "id", F.concat_ws(",", "tags").alias("tags"), "confidence")


def keyword_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.keyword_search(_queries(spark), _texts(spark, folder), 50).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def bm25_rerank(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    pool = retrieval.keyword_search(_queries(spark), texts, 50).join(texts, "id").select("query_id", "id", "rank", "text")
    return retrieval.bm25_rerank(_queries(spark), pool).select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.vector_search(*_vectors(spark, folder), 10).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


#: Queries of the composed search: text, the place among the embedded live blocks of the one whose vector stands for the text, and of the one it relates to.
HYBRID = [("q1", "which sensor reads the latency scale", 10, None), ("q2", "budget rose while monitor fell below the limit last year", 200, 300), ("q3", "gateway cached in 2024", None, 40), ("q4", "umbrella voucher key expires", 77, None), ("q5", "zzzz unheard", None, 40), ("q6", "before 2024 the kettle", None, None)]


def _hybrid(spark: SparkSession, folder: str, vectors: bool = True) -> DataFrame:
    """``query_id, text, vector, related_to`` of ``HYBRID``."""
    found = _embedded(spark, folder).join(records.keep(_blocks(spark, folder)).select("id"), "id", "left_semi")
    wanted = sorted({n for _, _, *ns in HYBRID for n in ns if n})
    first = found.orderBy("id").limit(wanted[-1])
    place = first.withColumn("n", F.row_number().over(Window.orderBy("id"))).where(F.col("n").isin(wanted))
    q = spark.createDataFrame(HYBRID, "query_id string, text string, v int, r int")
    q = q.join(F.broadcast(place.select(F.col("n").alias("v"), "vector")), "v", "left").join(F.broadcast(place.select(F.col("n").alias("r"), F.col("id").alias("related_to"))), "r", "left")
    return q.select("query_id", "text", "vector", "related_to") if vectors else q.select("query_id", "text", "related_to")


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    """``id, vector`` of usable vectors, once for each id."""
    e = table(spark, folder, "block_embeddings").where("size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < 1e30) and exists(embedding, x -> x <> 0)")
    return e.groupBy(F.col("block_id").alias("id")).agg(F.min("embedding").alias("vector"))


def _two_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the queries that have a vector: by keywords, and by cosine (the best 50 and those found by keywords)."""
    q, found = _hybrid(spark, folder).where("vector is not null"), _embedded(spark, folder)
    words = retrieval.keyword_search(q.select("query_id", "text"), _texts(spark, folder), 50)
    best = retrieval.vector_search(q.select("query_id", "vector"), found, 50)
    return words, best.unionByName(retrieval.vector_ranks(q.select("query_id", "vector"), found, words).select(best.columns)).distinct()


def rrf_merge(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rrf(*_two_lists(spark, folder)).select("query_id", "id", "score", "rank")


def weighted_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.rrf(*_two_lists(spark, folder), keyword_weight=0.4, vector_weight=0.6, bonus=0.5).select("query_id", "id", "score")


def time_window_interleave(spark: SparkSession, folder: str) -> DataFrame:
    words, vectors = _two_lists(spark, folder)
    return retrieval.interleave(words, vectors.where("rank <= 50")).where("rank <= 20")


def recall_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine ranking judged by the labels of the vectors."""
    e = table(spark, folder, "embeddings")
    found = retrieval.vector_search(*_vectors(spark, folder), 10)
    relevant = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("id"), "label"), "label").select("query_id", "id")
    return retrieval.evaluate(found, relevant, 10).select("query_id", F.round("recall", 4).alias("recall"), F.round("ndcg", 4).alias("ndcg"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword results with type, content, strength and relevance."""
    blocks = records.with_strength(records.keep(_blocks(spark, folder)), AS_OF)
    hits = retrieval.normalise(retrieval.keyword_curve(retrieval.keyword_search(_queries(spark), compose.searched_text(blocks).drop("created_at"), 50)))
    joined = hits.join(blocks.select("id", "type", "content", "confidence", "strength", "created_at"), "id")
    score = retrieval.relevance(F.col("score"), F.coalesce("confidence", F.lit(1.0)), F.col("strength"), scalars.recency(F.col("created_at"), F.lit(AS_OF).cast("timestamp")), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "id")
    return joined.withColumn("relevance", F.round(score, 4)).withColumn("rank", F.row_number().over(order))


def relevance_score(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).where("rank <= 10").select("query_id", "id", "relevance", "rank")


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    return context.within_budget(context.lines(_ranked(spark, folder)), 1500).select("query_id", "id", "rank", "spent")


def recall_greedy(spark: SparkSession, folder: str) -> DataFrame:
    return context.greedy(context.lines(_ranked(spark, folder)), 600)


def context_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return context.grouped(_ranked(spark, folder), 2000).select("query_id", "type", "n", "id", "spent")


def context_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return context.confidence_report(_ranked(spark, folder))


def heuristic_rerank(spark: SparkSession, folder: str) -> DataFrame:
    texts = _texts(spark, folder)
    pool = retrieval.keyword_search(_queries(spark), texts, 50).join(texts, "id").select("query_id", "id", "rank", "text")
    return rerank.heuristic(_queries(spark), pool).where("rank <= 10")


def multi_hop(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "hops")
    live = scratch.cut(graph.live_edges(table(spark, folder, "edges"), _blocks(spark, folder)), "live")
    facts = records.with_strength(records.keep(_blocks(spark, folder)), AS_OF).select("id", F.concat_ws(" ", "content", "tags").alias("text"), "type", "strength")
    return rerank.multi_hop(_queries(spark), facts, live, scratch)


def graph_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """Live neighbours of every record, counted."""
    found = graph.neighbours(table(spark, folder, "edges"), _blocks(spark, folder))
    return found.groupBy("id").agg(F.count("*").alias("n_neighbours"), F.min("neighbour").alias("first_neighbour"))


def graph_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbours(table(spark, folder, "edges"), _blocks(spark, folder), relation="contradicts", direction="outgoing")


def graph_bfs_depth(spark: SparkSession, folder: str) -> DataFrame:
    """Up to 2 steps from the keyword results."""
    scratch = Scratch(spark, "bfs")
    live = scratch.cut(graph.live_edges(table(spark, folder, "edges"), _blocks(spark, folder)), "live")
    starts = retrieval.keyword_search(_queries(spark), _texts(spark, folder), 10).select("id").distinct()
    found = graph.traverse(starts, live, scratch, 2)
    return found.groupBy("id").agg(F.min("depth").alias("depth"), F.count("*").alias("n_starts"))


def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "components")
    found = components(graph.live_edges(table(spark, folder, "edges"), _blocks(spark, folder)), scratch)
    return found.select(F.col("node").alias("id"), "component")


def auto_link_tags(spark: SparkSession, folder: str) -> DataFrame:
    return graph.tag_links(_blocks(spark, folder))


def oplog_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the authors' logs as they stand; the hashes of the test data are of an unknown recipe and are not judged."""
    return oplog.verify(table(spark, folder, "operations"), hashes=False).drop("n_hashed")


def _sealed(spark: SparkSession, folder: str) -> DataFrame:
    """A log sealed anew, with simple data."""
    ops = table(spark, folder, "operations").where("clock is not null and author is not null").select("author", "id", "clock", "timestamp", "action").distinct()
    return oplog.append(ops.withColumn("data", F.concat(F.lit('{"clock": '), "clock", F.lit("}"))))


def oplog_append(spark: SparkSession, folder: str) -> DataFrame:
    return _sealed(spark, folder).select("author", "id", "clock", "prev_hash", "hash")


def oplog_verify(spark: SparkSession, folder: str) -> DataFrame:
    """A sealed log of which some operations were changed and some are lost."""
    log = _sealed(spark, folder).where("clock % 101 <> 0").withColumn("action", F.when(F.col("clock") % 97 == 0, "changed").otherwise(F.col("action")))
    return oplog.verify(log)


def oplog_versions(spark: SparkSession, folder: str) -> DataFrame:
    return oplog.versions(table(spark, folder, "operations"))


def ingest_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return records.chunks(table(spark, folder, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "n", F.length("chunk").alias("n_chars"))


def question_entities(spark: SparkSession, folder: str) -> DataFrame:
    b = _blocks(spark, folder).where("content is not null")
    return b.select("id", F.explode(entities.of_record(F.col("content"), F.col("type"))).alias("entity"))


def query_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """The composed search with keywords, vectors, graph and time windows."""
    scratch = Scratch(spark, "hybrid")
    found = compose.search(_hybrid(spark, folder), _blocks(spark, folder), AS_OF, scratch, edges=table(spark, folder, "edges"), embeddings=_embedded(spark, folder).withColumnsRenamed({"id": "block_id", "vector": "embedding"}), stemmed=False)
    return found.select("query_id", "id", "rank", F.round("relevance", 4).alias("relevance"))


def query_refill(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords alone, only strong records; starved pools are filled up."""
    found = compose.search(_queries(spark), _blocks(spark, folder), AS_OF, Scratch(spark, "refill"), min_strength=0.55, stemmed=False)
    return found.select("query_id", "id", "rank", F.round("strength", 4).alias("strength"))


def query_time_window(spark: SparkSession, folder: str) -> DataFrame:
    """The window filters, unless nothing is inside; newest first."""
    found = compose.search(_hybrid(spark, folder, False).drop("related_to"), _blocks(spark, folder), AS_OF, Scratch(spark, "window"), time_window="filter", sort_by="recency", stemmed=False)
    return found.select("query_id", "id", "rank")


def query_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    return compose.search(_queries(spark), _blocks(spark, folder), AS_OF, Scratch(spark, "stemmed"), type="fact")


def keyword_throughput(spark: SparkSession, folder: str) -> DataFrame:
    """The first sentence of every live record as a query against all of them, in one job."""
    texts = _texts(spark, folder)
    asked = texts.select(F.col("id").alias("query_id"), F.regexp_extract("text", r"^[^.!?]*", 0).alias("text"))
    return retrieval.keyword_search(asked, texts, 10)


def time_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Bounds of phrases that every event asks about."""
    e = table(spark, folder, "events")
    said = F.expr(_PHRASE)
    w = phrases.time_window(said, F.lit(AS_OF).cast("timestamp"))
    return e.select("event_id", w["after"].alias("after"), w["before"].alias("before"), w["text"].alias("text"))


def follow_ups(spark: SparkSession, folder: str) -> DataFrame:
    """Follow-up questions after every pair of a user's events, made whole."""
    e = table(spark, folder, "events").withColumn("message", F.concat(F.lit("I saw the "), F.initcap("event_type"), F.lit(" Report again")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, -1)
    recent = F.collect_list("message").over(w)
    asked = F.element_at(F.array(*[F.lit(x) for x in ("tell me more", "What about it?", "why is that", "how does sand work")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", asked.alias("asked"), recent.alias("recent")).select("event_id", phrases.whole_question(F.col("asked"), F.col("recent")).alias("question"))


def edges_between(spark: SparkSession, folder: str) -> DataFrame:
    """The edges that run the other way of a contradiction."""
    e = table(spark, folder, "edges")
    pairs = e.where("relation = 'contradicts'").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return links.between(e, pairs).select("id", "source_id", "target_id")


def edge_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Edges that the rules of writing would refuse."""
    return links.broken(table(spark, folder, "edges").distinct(), _blocks(spark, folder))


def unlinked(spark: SparkSession, folder: str) -> DataFrame:
    """Edges removed per pair when all supports are taken back."""
    e = table(spark, folder, "edges")
    return links.unlink(e, e.where("relation = 'supports'").select("source_id", "target_id", "relation"))[1]


def auto_link_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Links of the embedded blocks of org_main to their nearest."""
    found = _embedded(spark, folder).join(records.keep(_blocks(spark, folder)).select("id", "org_id"), "id")
    return links.vector_links(found.where("org_id = 'org_main'").select("id", "vector"), found.select("id", "vector"))


def semantic_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded blocks of org_main that say the same as another block."""
    found = _embedded(spark, folder).join(records.keep(_blocks(spark, folder)).select("id", "org_id"), "id")
    out = dedup.semantic(found.where("org_id = 'org_main'").select("id", "vector"), found.select("id", "vector"))
    return out.select("id", F.round("similarity", 4).alias("similarity"))


def context_adaptive(spark: SparkSession, folder: str) -> DataFrame:
    blocks = records.with_strength(records.keep(_blocks(spark, folder)), AS_OF).select("id", "type", "content", "strength")
    seeds = _ranked(spark, folder).where("rank <= 20").select("query_id", "id")
    found = context.adaptive(seeds, graph.live_edges(table(spark, folder, "edges"), _blocks(spark, folder)), blocks)
    return found.where("rank <= 30").select("query_id", "id", "rank", "support")


def context_graph_walk(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "walk")
    blocks = records.with_strength(records.keep(_blocks(spark, folder)), AS_OF).select("id", "type", "content", "strength")
    best = scratch.cut(_ranked(spark, folder).where("rank = 1").select("query_id", "id"), "best")
    live = scratch.cut(graph.live_edges(table(spark, folder, "edges"), _blocks(spark, folder)), "live")
    found = context.graph_walk(best, graph.traverse(best.select("id").distinct(), live, scratch, 2), blocks)
    return context.within_budget(context.lines(found), 3000).select("query_id", "id", "depth", "rank", "spent")


def trouble_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose calls fail, return nothing or repeat."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("session_id"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"), F.col("event_type").alias("name"), "event_id", F.lit("{}").alias("arguments"))
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("at"))
    content = F.when(F.col("event_id") % 5 == 0, "[]").when(F.col("event_id") % 7 == 0, "Traceback: x").otherwise("fine")
    return trouble.detect(e.select("session_id", n.alias("n"), "name", "arguments", content.alias("content"), F.lit(None).cast("boolean").alias("is_error")))


def soft_delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """What is deleted after the weak blocks and all below them were, and what is left of edges."""
    scratch = Scratch(spark, "cascade")
    blocks = scratch.cut(_blocks(spark, folder), "blocks")
    before = lifecycle.Tables(blocks, table(spark, folder, "edges"), table(spark, folder, "block_embeddings"))
    after = lifecycle.soft_delete(before, blocks.where("confidence < 0.4").select("id"), scratch, cascade=True)
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return n(after.blocks.where("deleted"), "deleted").unionByName(n(after.edges, "edges")).unionByName(n(after.embeddings, "embeddings")).unionByName(n(after.operations, "operations"))


def block_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Contents of the events among the blocks in capitals: new versions and hashes."""
    blocks = _blocks(spark, folder)
    changes = blocks.where("type = 'event'").select("id", F.upper("content").alias("content"), F.lit(0.5).alias("confidence"))
    after = lifecycle.update(lifecycle.Tables(blocks, table(spark, folder, "edges"), table(spark, folder, "block_embeddings")), changes)
    return after.blocks.where("type = 'event'").select("id", "version", "confidence", F.upper("content").eqNullSafe(F.col("content")).alias("upper"))


def next_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Events as messages, written as episodes once for each receipt; the next turn of each session."""
    e = table(spark, folder, "events")
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    m = e.select(F.col("user_id").cast("string").alias("session_id"), F.floor(place / 2).cast("int").alias("turn"), (place % 2).alias("seq"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.concat("event_type", F.lit("-"), F.col("event_id") % 500).alias("receipt"), F.col("ts").cast("timestamp").alias("at"))
    return session.next_turn(session.episodes(m))


QUERIES = {
    f.__name__: f
    for f in (
        filter_scope, filter_tags_any, filter_metadata_json, filter_happened, decay_strength, strongest_topk, prune_candidates, record_violations, store_stats, sessions, session_history, sequential_links,
        question_counters, question_top, question_top_windowed, question_trending, question_stats, question_rollup, trouble_runs, content_hash_dups, dedup_merge, keyword_topk, bm25_rerank, cosine_topk,
        rrf_merge, weighted_rrf, time_window_interleave, recall_ndcg, relevance_score, context_budget, recall_greedy, context_grouped, context_confidence, heuristic_rerank, multi_hop, graph_neighbors, graph_contradictions,
        graph_bfs_depth, graph_components, auto_link_tags, oplog_links, oplog_append, oplog_verify, oplog_versions, ingest_chunks, question_entities,
        query_hybrid, query_refill, query_time_window, query_stemmed, keyword_throughput, time_windows, follow_ups, edges_between, edge_violations, unlinked, auto_link_semantic, semantic_dups,
        context_adaptive, context_graph_walk, trouble_repeats, soft_delete_cascade, block_updates, next_turns,
    )
} | {f"question_breakdown_{by}": question_breakdown(by) for by in ("daily", "weekly", "monthly")}

# SQL of shared parts
_B = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY access_count DESC, last_accessed DESC NULLS LAST) AS _n FROM blocks WHERE id IS NOT NULL) WHERE _n = 1), live AS (SELECT * FROM one WHERE NOT coalesce(deleted, false))"
_NOW = f"TIMESTAMPTZ '{AS_OF}+00'"
_RATES = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scalars.DECAY_RATES.items()) + " ELSE 0.005 END"
_HOURS = "greatest(0.0, (epoch_us({0}) - epoch_us({1})) / 3.6e9)"
_S = f"""strong AS (SELECT *, round(least(1.0, greatest(0.0, coalesce(confidence, 1.0) * exp(-coalesce(decay_rate, {_RATES}) * {_HOURS.format(_NOW, 'created_at')})
  * CASE WHEN coalesce(access_count, 0) > 0 THEN 1 + 0.3 * ln(1 + access_count) * (CASE WHEN last_accessed IS NULL THEN 1.0 ELSE exp(-0.01 * {_HOURS.format(_NOW, 'last_accessed')}) END) ELSE 1.0 END)), 6) AS strength FROM live)"""
_KEY = r"regexp_replace({0}, '[?!.,;:]+$', '')"
_NO = ", ".join("'" + w + "'" for w in entries(NOISE))
_A = rf"""asked AS (SELECT org_id, {_KEY.format(r"trim(regexp_replace(lower(nfc_normalize(raw)), '\s+', ' ', 'g'))")} AS question, user_id, asked_at
  FROM (SELECT 'org_' || (user_id % 5) AS org_id, {_QUESTION} AS raw, user_id, ts AS asked_at FROM events) WHERE length({_KEY.format('trim(lower(raw))')}) >= 3 AND {_KEY.format('trim(lower(raw))')} NOT IN ({_NO}))"""
_Q = "q(query_id, text) AS (VALUES " + ", ".join(f"('{i}', '{t}')" for i, t in TEXTS) + ")"
_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_DOCS = f"""docs AS (SELECT id, created_at, {_TOK.format('text')} AS w FROM (SELECT id, created_at, array_to_string(list_filter([content] || coalesce(tags, []), lambda x: x IS NOT NULL), ' ') AS text FROM live)),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs)"""


def _scores(q: str, name: str) -> str:
    """BM25 of the queries in ``q``."""
    return f"""qt_{name} AS (SELECT DISTINCT query_id, unnest({_TOK.format('text')}) AS term FROM {q}),
tf_{name} AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM qt_{name}) GROUP BY ALL),
df_{name} AS (SELECT term, count(*) AS df FROM tf_{name} GROUP BY term),
{name} AS (SELECT query_id, id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
  FROM tf_{name} JOIN df_{name} USING (term) JOIN qt_{name} USING (term) CROSS JOIN corpus GROUP BY query_id, id)"""


_KW = f"""{_B}, {_Q}, {_DOCS}, {_scores('q', 'kws')},
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kws QUALIFY rank <= 50)"""
_COS = "round(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 6)"


def _top(name: str, a: str, b: str, k: int) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT x.vec_id AS query_id, y.vec_id AS id, {_COS.format(a, b)} AS score FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0) QUALIFY rank <= {k})"


_EMB = "emb AS (SELECT block_id AS id, min(embedding) AS vector FROM block_embeddings WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e30 for x in embedding]) AND list_bool_or([x <> 0 for x in embedding]) GROUP BY 1)"
#: The composed search's queries with what their time phrases mean at ``AS_OF``, written by hand.
_MEANT = {"q2": ("budget rose while monitor fell below the limit", "TIMESTAMPTZ '2024-09-01 00:00:00+00'", _NOW), "q3": ("gateway cached", "TIMESTAMPTZ '2024-01-01 00:00:00+00'", "TIMESTAMPTZ '2025-01-01 00:00:00+00'"), "q6": ("the kettle", "NULL", "TIMESTAMPTZ '2024-01-01 00:00:00+00'")}
_HROWS = ", ".join(f"('{i}', '{t}', '{_MEANT.get(i, (t,))[0]}', {v or 'NULL'}, {r or 'NULL'}, " + ", ".join(f"CAST({x} AS TIMESTAMPTZ)" for x in _MEANT.get(i, ("", "NULL", "NULL"))[1:]) + ")" for i, t, v, r in HYBRID)
_HQ = f"""{_EMB}, lemb AS (SELECT id, vector, row_number() OVER (ORDER BY id) AS n FROM emb WHERE id IN (SELECT id FROM live)),
hq AS (SELECT h.query_id, h.raw, h.text, v.vector, r.id AS related_to, h.a, h.b, h.a IS NOT NULL OR h.b IS NOT NULL AS windowed FROM (VALUES {_HROWS}) h(query_id, raw, text, v, r, a, b) LEFT JOIN lemb v ON v.n = h.v LEFT JOIN lemb r ON r.n = h.r)"""
_TWO = f"""{_B}, {_DOCS}, {_HQ}, tq AS (SELECT query_id, raw AS text, vector FROM hq WHERE vector IS NOT NULL), {_scores('tq', 'tks')},
half AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM tks QUALIFY rank <= 50),
every AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT t.query_id, e.id, {_COS.format('t.vector', 'e.vector')} AS score FROM tq t, emb e)),
full_ AS (SELECT * FROM every WHERE rank <= 50 OR (query_id, id) IN (SELECT (query_id, id) FROM half))"""
_RRF = "SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce({0} / (60 + a.rank), 0) + coalesce({1} / (60 + b.rank), 0) AS s, coalesce(b.score, 0) AS cosine FROM half a FULL JOIN full_ b ON a.query_id = b.query_id AND a.id = b.id"
_LIVE_EDGES = """und AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges),
le AS MATERIALIZED (SELECT DISTINCT a, b FROM und WHERE a <> b AND a IN (SELECT id FROM one WHERE NOT deleted) AND b IN (SELECT id FROM one WHERE NOT deleted))"""
_REL = f"""{_KW}, {_S},
curve AS (SELECT query_id, id, round(4.0 / (3 + rank), 6) AS score FROM kw),
norm AS (SELECT query_id, id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM curve),
rel AS (SELECT n.query_id, n.id, s.type, s.content, s.strength, round(round(0.70 * score + 0.10 * coalesce(confidence, 1.0) + 0.05 * strength + 0.05 * greatest(0.0, 1 - {_HOURS.format(_NOW, 'created_at')} / 720), 6), 4) AS relevance
  FROM norm n JOIN strong s USING (id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM rel)"""
_COUNTERS = "counters AS (SELECT org_id, question, count(*) AS frequency, count(DISTINCT user_id) AS n_users, min(asked_at) AS first_asked, max(asked_at) AS last_asked FROM asked {0} GROUP BY ALL)"
_NORM = r"trim(regexp_replace(lower(nfc_normalize(content)), '\s+', ' ', 'g'))"

_ISO = "coalesce(strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END || '+00:00', '')"
_HASH = "'sha256:' || sha256({0} || '|' || coalesce(action, '') || '|{{\"clock\": ' || clock || '}}|' || iso)"
_CHAIN = f"""WITH RECURSIVE o AS (SELECT *, {_ISO} AS iso, row_number() OVER (PARTITION BY author ORDER BY clock, timestamp NULLS FIRST, id) AS n FROM (SELECT DISTINCT author, id, clock, timestamp, action FROM operations WHERE clock IS NOT NULL AND author IS NOT NULL)),
chain AS (SELECT *, '' AS prev_hash, {_HASH.format("''")} AS hash FROM o WHERE n = 1 UNION ALL SELECT o.*, c.hash, {_HASH.format('c.hash').replace('action', 'o.action').replace("|| clock", "|| o.clock").replace("|| iso", "|| o.iso")} FROM chain c JOIN o ON o.author = c.author AND o.n = c.n + 1)"""
#: Distance from the starts in ``s(start)`` over live edges, up to 3.
_WALK = """d1 AS (SELECT DISTINCT start, b AS id FROM s JOIN le ON start = a WHERE b <> start),
d2 AS (SELECT DISTINCT d1.start, le.b AS id FROM d1 JOIN le ON d1.id = le.a WHERE le.b <> d1.start), d3 AS (SELECT DISTINCT d2.start, le.b AS id FROM d2 JOIN le ON d2.id = le.a WHERE le.b <> d2.start),
walk AS (SELECT start, id, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY ALL)"""
_INSIDE = "(windowed AND coalesce((a IS NULL OR happened_at >= a) AND (b IS NULL OR happened_at <= b), false))"


def _list(name: str, inside: bool) -> str:
    """One ranking of the composed search, over all matches or those inside the windows."""
    only = f"WHERE {_INSIDE}" if inside else ""
    both = f"AND {_INSIDE}" if inside else ""
    return f"""c_{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC NULLS LAST, id) AS r FROM m {only}) WHERE r <= 50),
s_{name} AS (SELECT coalesce(c.query_id, v.query_id) AS query_id, coalesce(c.id, v.id) AS id, coalesce(0.4::DOUBLE / (60 + c.r), 0) + coalesce(0.6::DOUBLE / (60 + v.rank), 0) AS s, coalesce(v.score, 0) AS cosine
  FROM (SELECT * FROM c_{name} WHERE query_id IN (SELECT query_id FROM vec)) c FULL JOIN vec v ON c.query_id = v.query_id AND c.id = v.id),
g_{name} AS (SELECT query_id, id, round(s + 0.5 * max(s) OVER (PARTITION BY query_id) * cosine, 6) AS score FROM s_{name}),
n_{name} AS (SELECT *, round(score / max(score) OVER (PARTITION BY query_id), 6) AS sem, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM g_{name}),
f_{name} AS (SELECT query_id, id FROM c_{name}
  UNION SELECT n.query_id, n.id FROM n_{name} n JOIN strong USING (id) JOIN hq USING (query_id) WHERE place <= 50 {both}
  UNION SELECT w.query_id, w.id FROM near w JOIN strong USING (id) JOIN hq USING (query_id) WHERE query_id NOT IN (SELECT query_id FROM c_{name}) {both}),
o_{name} AS (SELECT f.query_id, f.id, round(0.70 * coalesce(n.sem, CASE WHEN f.query_id NOT IN (SELECT query_id FROM vec) THEN 4.0::DOUBLE / (3 + c.r) END, 0) + 0.10 * coalesce(st.confidence, 1.0) + 0.05 * st.strength
  + 0.05 * greatest(0.0, 1 - {_HOURS.format(_NOW, 'st.created_at')} / 720) + 0.10 * coalesce(w.near, 0), 6) AS relevance
  FROM f_{name} f JOIN strong st USING (id) LEFT JOIN n_{name} n ON n.query_id = f.query_id AND n.id = f.id LEFT JOIN c_{name} c ON c.query_id = f.query_id AND c.id = f.id LEFT JOIN near w ON w.query_id = f.query_id AND w.id = f.id),
l_{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM o_{name})"""


_COMPOSED = f"""WITH {_B}, {_S}, {_DOCS}, {_HQ}, {_LIVE_EDGES}, {_scores('hq', 'ks')},
m AS (SELECT ks.*, st.created_at, st.happened_at, hq.a, hq.b, hq.windowed FROM ks JOIN strong st USING (id) JOIN hq USING (query_id)),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT hq.query_id, e.id, {_COS.format('hq.vector', 'e.vector')} AS score FROM hq, lemb e WHERE hq.vector IS NOT NULL)),
s AS (SELECT DISTINCT related_to AS start FROM hq WHERE related_to IS NOT NULL), {_WALK}, near AS (SELECT query_id, id, 0.3::DOUBLE / depth AS near FROM hq JOIN walk ON related_to = start),
{_list('all', False)}, {_list('in', True)}"""
_TOPS = f"SELECT query_id, id, {_COS.format('x.vector', 'y.vector')} AS score FROM (SELECT id AS query_id, vector FROM emb JOIN live USING (id) WHERE org_id = 'org_main') x, (SELECT id, vector FROM emb JOIN live USING (id)) y WHERE query_id <> id"

ORACLES = {
    "query_hybrid": f"""{_COMPOSED}, p AS (SELECT query_id, id, min(place) AS place FROM (SELECT query_id, id, 2 * rank AS place FROM l_in WHERE rank <= 10 UNION ALL SELECT query_id, id, 2 * rank + 1 FROM l_all WHERE rank <= 10) GROUP BY ALL),
v AS (SELECT query_id, id, max(relevance) AS relevance FROM (SELECT * FROM l_in UNION ALL SELECT * FROM l_all) GROUP BY ALL)
SELECT p.query_id, p.id, CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY p.place, p.id) AS INT) AS rank, round(v.relevance, 4) AS relevance FROM p JOIN v USING (query_id, id) QUALIFY rank <= 10""",
    "query_refill": f"""WITH {_B}, {_S}, {_Q}, {_DOCS}, {_scores('q', 'ks')}, m AS (SELECT ks.query_id, st.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC NULLS LAST, id) AS r FROM ks JOIN strong st USING (id)),
t AS (SELECT *, count(*) OVER (PARTITION BY query_id) >= 50 AND sum(CASE WHEN r <= 50 AND strength >= 0.55 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) < 10 AS starved FROM m),
c AS (SELECT *, round(0.70 * 4.0::DOUBLE / (3 + r) + 0.10 * coalesce(confidence, 1.0) + 0.05 * strength + 0.05 * greatest(0.0, 1 - {_HOURS.format(_NOW, 'created_at')} / 720), 6) AS relevance FROM t WHERE (r <= 50 OR starved) AND strength >= 0.55)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS INT) AS rank, round(strength, 4) AS strength FROM c QUALIFY rank <= 10""",
    "query_time_window": f"""WITH {_B}, {_DOCS}, {_HQ}, {_scores('hq', 'ks')}, m AS (SELECT ks.query_id, l.id, l.created_at, hq.windowed, {_INSIDE} AS inside FROM ks JOIN live l USING (id) JOIN hq USING (query_id)),
k AS (SELECT *, max(inside) OVER (PARTITION BY query_id) AS one_in FROM m)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST, id) AS INT) AS rank FROM k WHERE NOT windowed OR inside OR NOT one_in QUALIFY rank <= 10""",
    "keyword_throughput": f"""WITH {_B}, {_DOCS}, tq AS (SELECT id AS query_id, regexp_extract(array_to_string(list_filter([content] || coalesce(tags, []), lambda x: x IS NOT NULL), ' '), '^[^.!?]*') AS text FROM live), {_scores('tq', 'ks')}
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM ks QUALIFY rank <= 10""",
    "context_grouped": f"""WITH {_REL}, t AS (SELECT *, list_position(['fact', 'preference', 'entity', 'event', 'relation'], type) AS o, row_number() OVER (PARTITION BY query_id, type ORDER BY strength DESC, id) AS n FROM ranked),
l AS (SELECT query_id, type, o, n, id, floor(length('[' || type || '] (' || printf('%.2f', strength) || ' ' || CASE WHEN strength >= 0.9 THEN 'HIGH' WHEN strength >= 0.7 THEN 'MED' WHEN strength >= 0.4 THEN 'LOW' ELSE 'WEAK' END || ') ' || coalesce(content, '')) / 4) AS cost FROM t WHERE o IS NOT NULL AND n <= 20),
h AS (SELECT DISTINCT query_id, type, o, 0 AS n, CAST(NULL AS VARCHAR) AS id, floor((3 + length(type)) / 4) AS cost FROM l)
SELECT query_id, type, CAST(n AS INT) AS n, id, CAST(4 + sum(cost) OVER (PARTITION BY query_id ORDER BY o, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM (SELECT * FROM l UNION ALL SELECT * FROM h) QUALIFY spent <= 2000""",
    "time_windows": f"""WITH e AS (SELECT event_id, event_type, event_id % 12 AS k, event_id % 50 AS n, TIMESTAMP '{AS_OF}' AS t FROM events),
w AS (SELECT *, CASE k WHEN 0 THEN t - INTERVAL 1 DAY WHEN 1 THEN t WHEN 2 THEN t - INTERVAL 30 DAY WHEN 3 THEN date_trunc('day', t - to_days(CAST(7 * n + greatest(1, n) AS INT))) WHEN 4 THEN t - INTERVAL 7 DAY WHEN 5 THEN TIMESTAMP '2025-03-01' WHEN 6 THEN TIMESTAMP '2023-12-01' WHEN 7 THEN TIMESTAMP '2022-01-01' WHEN 9 THEN TIMESTAMP '2025-01-01' WHEN 10 THEN TIMESTAMP '2025-08-26' END AS a,
  CASE k WHEN 0 THEN t WHEN 1 THEN t + INTERVAL 1 DAY WHEN 2 THEN t WHEN 3 THEN t - to_days(CAST(7 * n - greatest(1, n) AS INT)) WHEN 4 THEN t WHEN 5 THEN TIMESTAMP '2025-04-01' WHEN 6 THEN TIMESTAMP '2024-01-01' WHEN 7 THEN TIMESTAMP '2023-01-01' WHEN 8 THEN TIMESTAMP '2024-06-01' WHEN 10 THEN TIMESTAMP '2025-08-27' END AS b FROM e)
SELECT event_id, CAST(a AS TIMESTAMPTZ) AS after, CAST(b AS TIMESTAMPTZ) AS before, CASE WHEN k < 11 THEN 'About and ' || event_type END AS text FROM w""",
    "follow_ups": """WITH e AS (SELECT event_id, ['tell me more', 'What about it?', 'why is that', 'how does sand work'][event_id % 4 + 1] AS asked, lag(upper(event_type[1]) || event_type[2:]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)
SELECT event_id, CASE WHEN t IS NULL THEN asked ELSE CASE event_id % 4 WHEN 0 THEN 'tell me more about ' || t || ' Report' WHEN 1 THEN 'what about ' || t || ' Report' WHEN 2 THEN 'why ' || t || ' Report' ELSE asked END END AS question FROM e""",
    "edges_between": "SELECT DISTINCT id, source_id, target_id FROM edges WHERE (source_id, target_id) IN (SELECT (target_id, source_id) FROM edges WHERE relation = 'contradicts' AND source_id IS NOT NULL AND target_id IS NOT NULL)",
    "edge_violations": f"""WITH {_B}, j AS (SELECT e.*, a.type AS st, b.type AS tt, a.id IS NOT NULL AND a.type IS NOT NULL AND b.type IS NOT NULL AS there FROM edges e LEFT JOIN live a ON e.source_id = a.id LEFT JOIN live b ON e.target_id = b.id)
SELECT DISTINCT id, 'source does not exist' AS rule FROM j WHERE st IS NULL UNION SELECT id, 'target does not exist' FROM j WHERE tt IS NULL UNION SELECT id, 'weight outside 0 to 1' FROM j WHERE NOT weight BETWEEN 0 AND 1
UNION SELECT id, 'target must be an entity' FROM j WHERE there AND relation IN ('about', 'part_of') AND tt <> 'entity'
UNION SELECT id, 'cause must lead from an event to an event or fact' FROM j WHERE there AND relation = 'caused_by' AND NOT (st = 'event' AND tt IN ('event', 'fact'))""",
    "unlinked": "SELECT source_id, target_id, count(DISTINCT id) AS removed FROM edges WHERE relation = 'supports' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY ALL",
    "auto_link_semantic": f"WITH {_B}, {_EMB} SELECT query_id AS source_id, id AS target_id, round(least(0.9, 0.3 + 1.2 * (score - 0.5)), 6)::DOUBLE AS weight FROM ({_TOPS}) WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5",
    "semantic_dups": f"WITH {_B}, {_EMB} SELECT query_id AS id, round(max(score), 4) AS similarity FROM ({_TOPS}) GROUP BY 1 HAVING max(score) >= 0.95",
    "context_adaptive": f"""WITH {_REL}, {_LIVE_EDGES}, seed AS (SELECT query_id, id FROM ranked WHERE rank <= 20),
t AS (SELECT query_id, b AS id, count(*) AS support FROM seed JOIN le ON seed.id = le.a GROUP BY ALL), u AS (SELECT query_id, id, max(support) AS support FROM (SELECT * FROM t UNION ALL SELECT query_id, id, 0 FROM seed) GROUP BY ALL)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(strength + 0.1 * support, 6) DESC, id) AS INT) AS rank, support FROM u JOIN strong USING (id) QUALIFY rank <= 30""",
    "context_graph_walk": f"""WITH {_REL}, {_LIVE_EDGES}, best AS (SELECT query_id, id FROM ranked WHERE rank = 1), s AS (SELECT DISTINCT id AS start FROM best), {_WALK},
f AS (SELECT query_id, id, 0 AS depth FROM best UNION ALL SELECT query_id, walk.id, depth FROM best JOIN walk ON best.id = walk.start WHERE depth <= 2),
l AS (SELECT query_id, id, depth, row_number() OVER (PARTITION BY query_id ORDER BY depth, strength DESC, id) AS rank,
  floor(length('[' || type || '] (' || printf('%.2f', strength) || ' ' || CASE WHEN strength >= 0.9 THEN 'HIGH' WHEN strength >= 0.7 THEN 'MED' WHEN strength >= 0.4 THEN 'LOW' ELSE 'WEAK' END || ') ' || coalesce(content, '')) / 4) AS cost FROM f JOIN strong USING (id))
SELECT query_id, id, CAST(depth AS INT) AS depth, CAST(rank AS INT) AS rank, CAST(4 + sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM l QUALIFY spent <= 3000""",
    "soft_delete_cascade": f"""WITH RECURSIVE {_B}, {_PARENTS}, gone AS (SELECT id FROM one WHERE confidence < 0.4 UNION SELECT p.id FROM gone g JOIN par p ON p.up = g.id), hit AS (SELECT id FROM gone WHERE id IN (SELECT id FROM live))
SELECT 'deleted' AS what, count(*) AS n FROM one WHERE coalesce(deleted, false) OR id IN (SELECT id FROM hit) UNION ALL SELECT 'edges', count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = e.source_id) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = e.target_id)
UNION ALL SELECT 'embeddings', count(*) FROM block_embeddings e WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.id = e.block_id) UNION ALL SELECT 'operations', count(*) FROM hit""",
    "block_updates": f"WITH {_B} SELECT id, CAST(coalesce(version, 1) + CASE WHEN coalesce(deleted, false) THEN 0 ELSE 1 END AS INT) AS version, CASE WHEN coalesce(deleted, false) THEN confidence ELSE 0.5 END AS confidence, NOT coalesce(deleted, false) OR upper(content) IS NOT DISTINCT FROM content AS upper FROM one WHERE type = 'event'",
    "next_turns": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events), m AS (SELECT CAST(user_id AS VARCHAR) AS session_id, k // 2 AS turn, k % 2 AS seq, event_type, event_type || '-' || (event_id % 500) AS receipt FROM p)
SELECT session_id, CAST(1 + max(turn) AS INT) AS turn FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY receipt ORDER BY turn, seq, event_type, session_id) = 1) GROUP BY 1""",
    "filter_scope": f"WITH {_B} SELECT id, confidence, project_id FROM live WHERE type = 'fact' AND confidence >= 0.5 AND org_id = 'org_main'",
    "filter_tags_any": f"WITH {_B}, w AS (SELECT DISTINCT unnest(tags) AS tag FROM one WHERE org_id = 'org_main') SELECT DISTINCT id FROM (SELECT id, unnest(tags) AS tag FROM live) WHERE tag IN (SELECT tag FROM w)",
    "filter_metadata_json": f"WITH {_B} SELECT id, custom_metadata FROM live WHERE CASE WHEN json_valid(custom_metadata) THEN json_extract_string(custom_metadata, '$.ver') END = '19'",
    "filter_happened": f"WITH {_B} SELECT id, happened_at FROM live WHERE happened_at BETWEEN TIMESTAMPTZ '2024-06-01 00:00:00+00' AND TIMESTAMPTZ '2025-03-01 00:00:00+00'",
    "decay_strength": f"WITH {_B}, {_S} SELECT id, round(strength, 4) AS strength FROM strong",
    "strongest_topk": f"WITH {_B}, {_S} SELECT id, round(strength, 4) AS strength FROM strong ORDER BY 2 DESC, id LIMIT 50",
    "prune_candidates": f"WITH {_B}, {_S} SELECT * FROM (SELECT id, CASE WHEN (epoch_us({_NOW}) - epoch_us(created_at)) / 1e6 > ttl THEN 'expired' WHEN strength < 0.1 THEN 'weak' END AS reason FROM strong) WHERE reason IS NOT NULL",
    "record_violations": f"""WITH {_B} SELECT id, 'content is empty' AS rule FROM one WHERE trim(coalesce(content, '')) = '' UNION ALL SELECT id, 'confidence outside 0 to 1' FROM one WHERE NOT confidence BETWEEN 0 AND 1
UNION ALL SELECT id, 'decay rate below 0' FROM one WHERE decay_rate < 0 UNION ALL SELECT id, 'time to live not positive' FROM one WHERE ttl <= 0
UNION ALL SELECT DISTINCT id, 'empty tag' FROM (SELECT id, unnest(tags) AS t FROM one) WHERE t IS NULL OR trim(t) = '' UNION ALL SELECT id, 'ends before it began' FROM one WHERE happened_at_end < happened_at""",
    "store_stats": f"WITH {_B} SELECT CASE WHEN coalesce(deleted, false) THEN 'deleted' ELSE 'live ' || coalesce(type, '?') END AS metric, count(*) AS value FROM one GROUP BY 1 UNION ALL SELECT 'edges', count(DISTINCT id) FROM edges UNION ALL SELECT 'operations', count(DISTINCT id) FROM operations UNION ALL SELECT 'embeddings', count(DISTINCT block_id) FROM block_embeddings",
    "sessions": f"WITH {_B} SELECT session_id, count(*) AS n, arg_min(id, (created_at, id)) AS first_id, arg_max(id, (created_at, id)) AS last_id FROM live WHERE session_id IS NOT NULL GROUP BY 1",
    "session_history": f"WITH {_B}, n AS (SELECT session_id, id, created_at FROM live WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) <= 5) SELECT session_id, id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS INT) AS place FROM n",
    "sequential_links": f"WITH {_B} SELECT * FROM (SELECT id AS source_id, lag(id) OVER (PARTITION BY session_id ORDER BY created_at, id) AS target_id, 0.8::DOUBLE AS weight FROM live WHERE session_id IS NOT NULL) WHERE target_id IS NOT NULL",
    "question_counters": f"WITH {_A}, {_COUNTERS.format('')} SELECT org_id, question, frequency, n_users, first_asked::TIMESTAMPTZ AS first_asked, last_asked::TIMESTAMPTZ AS last_asked FROM counters",
    "question_top": f"WITH {_A}, {_COUNTERS.format('')} SELECT org_id, CAST(row_number() OVER (PARTITION BY org_id ORDER BY frequency DESC, question) AS INT) AS rank, question, frequency, n_users FROM counters QUALIFY rank <= 20",
    "question_top_windowed": f"""WITH {_A}, w AS (SELECT *, asked_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AS i FROM asked),
c AS (SELECT org_id, question, count_if(i) AS frequency, count(DISTINCT CASE WHEN i THEN user_id END) AS n_users, count(*) AS lifetime FROM w GROUP BY ALL HAVING count_if(i) > 0)
SELECT org_id, CAST(row_number() OVER (PARTITION BY org_id ORDER BY frequency DESC, question) AS INT) AS rank, question, frequency, n_users, lifetime FROM c QUALIFY rank <= 20""",
    "question_trending": f"""WITH {_A}, t AS (SELECT org_id, question, count(*) AS total, count_if(asked_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY) AS recent, min(asked_at) AS f FROM asked GROUP BY ALL),
s AS (SELECT org_id, question, recent, total, round((recent / 7.0::DOUBLE) / (total / greatest(1, floor((epoch_us(TIMESTAMP '{EVENTS_AS_OF}') - epoch_us(f)) / 8.64e10))), 6) AS score FROM t WHERE recent > 0)
SELECT *, CAST(row_number() OVER (PARTITION BY org_id ORDER BY score DESC, question) AS INT) AS rank FROM s QUALIFY rank <= 10""",
    "question_breakdown_daily": f"WITH {_A} SELECT org_id, strftime(asked_at, '%Y-%m-%d') AS period, count(*) AS n, count(DISTINCT user_id) AS n_users FROM asked GROUP BY ALL",
    "question_breakdown_weekly": f"WITH {_A} SELECT org_id, strftime(asked_at, '%G-W%V') AS period, count(*) AS n, count(DISTINCT user_id) AS n_users FROM asked GROUP BY ALL",
    "question_breakdown_monthly": f"WITH {_A} SELECT org_id, strftime(asked_at, '%Y-%m') AS period, count(*) AS n, count(DISTINCT user_id) AS n_users FROM asked GROUP BY ALL",
    "question_stats": f"WITH {_A}, {_COUNTERS.format('')}, u AS (SELECT org_id, count(DISTINCT user_id) AS n_users FROM asked GROUP BY 1) SELECT org_id, count(*) AS n_questions, CAST(sum(frequency) AS BIGINT) AS n_asked, arg_max(question, (frequency, question)) AS top_question, any_value(u.n_users) AS n_users FROM counters JOIN u USING (org_id) GROUP BY org_id",
    "question_rollup": f"WITH {_A} SELECT org_id, day, count(*) AS n FROM (SELECT org_id, strftime(asked_at, '%Y-%m-%d') AS day FROM asked) GROUP BY ROLLUP (org_id, day)",
    "trouble_runs": """WITH c AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed FROM events), r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT event_id, user_id, n AS run_length FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, run, failed ORDER BY ts, event_id) AS INT) AS n FROM r) WHERE failed AND n % 2 = 0""",
    "content_hash_dups": f"WITH {_B} SELECT sha256({_NORM}) AS hash, arg_min(id, (created_at, id)) AS keep_id, count(*) AS n FROM one WHERE NOT deleted GROUP BY 1 HAVING count(*) > 1",
    "dedup_merge": f"WITH {_B} SELECT sha256({_NORM}) AS hash, arg_min(id, (created_at, id)) AS id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') AS tags, max(confidence) AS confidence FROM one WHERE NOT deleted GROUP BY 1",
    "keyword_topk": f"WITH {_KW} SELECT query_id, id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM kw",
    "bm25_rerank": f"""WITH {_KW}, qr AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOK.format('text')}) AS term FROM q) GROUP BY ALL),
p AS (SELECT k.query_id, k.id, k.rank, d.w FROM kw k JOIN docs d USING (id)), st AS (SELECT query_id, count(*) AS pn, avg(len(w)) AS pm FROM p GROUP BY 1),
pt AS (SELECT query_id, id, dl, term, count(*) AS ptf FROM (SELECT query_id, id, len(w) AS dl, unnest(w) AS term FROM p) GROUP BY ALL), pd AS (SELECT query_id, term, count(*) AS pdf FROM pt GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(times * ln((pn - pdf + 0.5) / (pdf + 0.5) + 1) * ptf * 2.5 / (ptf + 1.5 * (1 - 0.75 + 0.75 * dl / pm))), 6) AS score FROM pt JOIN qr USING (query_id, term) JOIN pd USING (query_id, term) JOIN st USING (query_id) GROUP BY ALL)
SELECT p.query_id, p.id, round(coalesce(score, 0), 4) AS score, CAST(row_number() OVER (PARTITION BY p.query_id ORDER BY coalesce(score, 0) DESC, p.rank, p.id) AS INT) AS rank FROM p LEFT JOIN sc USING (query_id, id)""",
    "cosine_topk": f"WITH {_top('t', 'x.embedding', 'y.embedding', 10)} SELECT query_id, id, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM t",
    "rrf_merge": f"WITH {_TWO}, m AS ({_RRF.format('1.0::DOUBLE', '1.0::DOUBLE')}), s AS (SELECT query_id, id, round(s, 6) AS score FROM m) SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM s",
    "weighted_rrf": f"WITH {_TWO}, m AS ({_RRF.format('0.4::DOUBLE', '0.6::DOUBLE')}) SELECT query_id, id, round(s + 0.5 * max(s) OVER (PARTITION BY query_id) * cosine, 6) AS score FROM m",
    "time_window_interleave": f"WITH {_TWO}, p AS (SELECT query_id, id, min(place) AS place FROM (SELECT query_id, id, 2 * rank AS place FROM half UNION ALL SELECT query_id, id, 2 * rank + 1 FROM full_ WHERE rank <= 50) GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place, id) AS INT) AS rank FROM p QUALIFY rank <= 20",
    "recall_ndcg": f"""WITH {_top('t', 'x.embedding', 'y.embedding', 10)}, r AS (SELECT x.vec_id AS query_id, y.vec_id AS id FROM embeddings x JOIN embeddings y USING (label) WHERE x.vec_id % 20 = 0), w AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1),
f AS (SELECT query_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg FROM t JOIN r USING (query_id, id) GROUP BY 1)
SELECT query_id, round(round(coalesce(hits, 0) / n::DOUBLE, 6), 4) AS recall, round(round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6), 4) AS ndcg FROM w LEFT JOIN f USING (query_id)""",
    "relevance_score": f"WITH {_REL} SELECT query_id, id, relevance, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10",
    "context_confidence": f"WITH {_REL} SELECT query_id, count(*) AS n, round(max(strength), 6) AS best, round(avg(strength), 6) AS mean, count(DISTINCT type) AS n_types, max(strength) >= 0.7 AS confident FROM ranked GROUP BY 1",
    "context_budget": f"""WITH {_REL}, l AS (SELECT *, floor(length('[' || type || '] (' || printf('%.2f', strength) || ' ' || CASE WHEN strength >= 0.9 THEN 'HIGH' WHEN strength >= 0.7 THEN 'MED' WHEN strength >= 0.4 THEN 'LOW' ELSE 'WEAK' END || ') ' || coalesce(content, '')) / 4) AS cost FROM ranked)
SELECT query_id, id, CAST(rank AS INT) AS rank, CAST(4 + sum(cost) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM l QUALIFY spent <= 1500""",
    "graph_neighbors": f"WITH {_B}, {_LIVE_EDGES} SELECT a AS id, count(*) AS n_neighbours, min(b) AS first_neighbour FROM le GROUP BY 1",
    "graph_contradictions": f"WITH {_B} SELECT DISTINCT source_id AS id, target_id AS neighbour FROM edges WHERE relation = 'contradicts' AND target_id IN (SELECT id FROM one WHERE NOT deleted)",
    "graph_bfs_depth": f"""WITH {_KW}, {_LIVE_EDGES}, s AS (SELECT DISTINCT id AS start FROM kw WHERE rank <= 10), d1 AS (SELECT DISTINCT start, b AS id FROM s JOIN le ON start = a WHERE b <> start),
d2 AS (SELECT DISTINCT d1.start, le.b AS id FROM d1 JOIN le ON d1.id = le.a WHERE le.b <> d1.start AND (d1.start, le.b) NOT IN (SELECT (start, id) FROM d1))
SELECT id, CAST(min(depth) AS INT) AS depth, count(*) AS n_starts FROM (SELECT start, id, 1 AS depth FROM d1 UNION ALL SELECT start, id, 2 FROM d2) GROUP BY 1""",
    "auto_link_tags": f"""WITH {_B}, t AS (SELECT id, created_at, unnest(list_distinct(tags)) AS tag FROM one WHERE NOT deleted), n AS (SELECT id, tag FROM t QUALIFY row_number() OVER (PARTITION BY tag ORDER BY created_at DESC, id) <= 50),
s AS (SELECT a.id AS source_id, b.id AS target_id, count(*) AS shared FROM n a JOIN n b USING (tag) WHERE a.id <> b.id GROUP BY ALL)
SELECT source_id, target_id, round(least(1.0, 0.3 + 0.2 * shared), 6)::DOUBLE AS weight FROM s QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY shared DESC, target_id) <= 5""",
    "oplog_links": """WITH o AS (SELECT DISTINCT id, author, clock, timestamp, action, data, hash, prev_hash FROM operations WHERE clock IS NOT NULL AND author IS NOT NULL),
l AS (SELECT *, lag(hash, 1, '') OVER (PARTITION BY author ORDER BY clock, timestamp NULLS FIRST, id) IS NOT DISTINCT FROM coalesce(prev_hash, '') AS linked FROM o)
SELECT author, CAST(count(*) AS BIGINT) AS n, CAST(count_if(linked) AS BIGINT) AS n_linked, arg_min(id, (clock, timestamp, id)) FILTER (WHERE NOT linked) AS first_broken FROM l GROUP BY 1""",
    "oplog_append": f"{_CHAIN} SELECT author, id, clock, prev_hash, hash FROM chain",
    "oplog_verify": f"""{_CHAIN}, kept AS (SELECT * EXCLUDE (action), CASE WHEN clock % 97 = 0 THEN 'changed' ELSE action END AS action FROM chain WHERE clock % 101 <> 0),
l AS (SELECT *, lag(hash, 1, '') OVER (PARTITION BY author ORDER BY clock, timestamp NULLS FIRST, id) = prev_hash AS linked, hash = {_HASH.format('prev_hash')} AS hashed FROM kept)
SELECT author, CAST(count(*) AS BIGINT) AS n, CAST(count_if(linked) AS BIGINT) AS n_linked, CAST(count_if(hashed) AS BIGINT) AS n_hashed, arg_min(id, (clock, timestamp, id)) FILTER (WHERE NOT (linked AND hashed)) AS first_broken FROM l GROUP BY 1""",
    "oplog_versions": "SELECT block_id, count(*) AS version, arg_max(id, (coalesce(clock, -1), timestamp, id)) AS last_op FROM (SELECT DISTINCT id, block_id, clock, timestamp FROM operations WHERE block_id <> '') GROUP BY 1",
}
