"""Keyword, vector and hybrid retrieval of many queries against many records at once.

Queries are a stated set, ``query_id`` with ``text`` or ``vector``; records are ``id`` with ``text`` or ``vector``. Ranks end in the id, so
ties have one order. Scores are rounded to 6 decimals before they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scalars
from quillstone.functions.stem import stems
from quillstone.plans.scratch import Scratch

K1, B = 1.2, 0.75
#: Query terms up to this number are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Shares of the records in which frequent terms, and those of the middle, occur; records of one task.
OFTEN, MIDDLE, DOCS = 0.1, 0.03, 60_000
#: Stands in for a term in the rows that count records by length.
_LENGTHS = "\x00"


def analysed(text: Column, stemmed: bool) -> Column:
    """Lower-case tokens, or their stems."""
    return stems(scalars.tokens(text)) if stemmed else scalars.tokens(text)


def query_terms(queries: DataFrame, repeat: bool = False, stemmed: bool = False) -> DataFrame:
    terms = analysed(F.col("text"), stemmed)
    return queries.select("query_id", F.explode(terms if repeat else F.array_distinct(terms)).alias("term"))


def _hits(queries: DataFrame, records: DataFrame, stemmed: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, float]:
    """Query terms ``query_id, term``; their hits ``term, id, length, tf``; the number of records and their mean length.

    One pass over the records tokenises each once. Only tokens of queries are kept before anything is shuffled; rows without
    a term, combined before the shuffle, count the records by length. The hits are written, so every later step reads them only.
    """
    terms = scratch.cut(query_terms(queries, stemmed=stemmed), "terms")
    wanted = scratch.cut(terms.select("term").distinct().unionByName(records.sparkSession.createDataFrame([(_LENGTHS,)], "term string")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    words = records.select("id", analysed(F.col("text"), stemmed).alias("words")).where("words is not null")
    each = words.select("id", F.size("words").alias("length"), F.explode(F.concat(F.array(F.lit(_LENGTHS)), "words")).alias("term")).join(wanted, "term", "left_semi")
    each = each.withColumn("id", F.when(F.col("term") != _LENGTHS, F.col("id")))
    hits = scratch.cut(each.groupBy("term", "id", "length").agg(F.count("*").alias("tf")), "hits")
    n, mean = hits.where(F.col("term") == _LENGTHS).agg(F.coalesce(F.sum("tf"), F.lit(0)), F.sum(F.col("tf") * F.col("length")) / F.sum("tf")).first()
    return terms, hits.where(F.col("term") != _LENGTHS), n, mean or 1.0


def keyword_scores(queries: DataFrame, records: DataFrame, stemmed: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """``query_id, id, score`` of every match: any term matches; BM25 over all records."""
    terms, hits, n, mean = _hits(queries, records, stemmed, scratch or Scratch(records.sparkSession, "keywords"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return hits.join(df, "term").join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def _best_by_keywords(shared, mean: float, most: int) -> Callable:  # noqa: ANN001
    """The best of the records of a task, ``id, length, codes, tfs``, for a block of queries: ``query_id, ids, scores``.

    Queries with the same frequent terms share the sums over these. Records with none of a query's rarer terms are beaten by the best
    of these sums alone, so a query looks at that short list and at the records of its rarer terms, in two steps of rarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        names, vocabulary, idf, often, asked = shared.value
        t = pa.Table.from_batches(held).sort_by("id")  # the place of a record breaks ties
        ids, codes, tf = t["id"].combine_chunks(), t["codes"], t["tfs"]
        size = pc.list_value_length(codes).to_numpy()
        code, tf = (x.combine_chunks().flatten().to_numpy() for x in (codes, tf))
        doc, tf = np.repeat(np.arange(len(ids), dtype=np.int32), size), tf.astype(float)
        term = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
        ok = vocabulary[term] == code
        doc, tf, term = doc[ok], tf[ok], term[ok]
        part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * t["length"].to_numpy()[doc] / mean))
        o = np.argsort(term, kind="stable")
        doc, part, start = doc[o], part[o], np.searchsorted(term[o], np.arange(len(vocabulary) + 1)).tolist()
        dense = {}
        for x in np.flatnonzero(often).tolist():
            dense[x] = np.zeros(len(ids))
            dense[x][doc[start[x] : start[x + 1]]] = part[start[x] : start[x + 1]]

        def top(places: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            """The best by rounded score and place, and the least score that may still be among them."""
            value = np.round(sums, 6)
            o = np.lexsort((places, -value))[:most]
            return places[o], value[o], value[o[-1]] - 1e-6 if len(o) == most else 0.0

        def better(sums: np.ndarray, terms: tuple[int, ...], pool: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
            """Adds some terms to ``sums``; the best then, with the places changed and what they held."""
            spans = [slice(start[x], start[x + 1]) for x in terms]
            at = np.concatenate([doc[x] for x in spans])
            before = sums[at]
            for x in spans:
                sums[doc[x]] += part[x]
            some = np.unique(np.concatenate((pool, at[sums[at] >= least])))
            return *top(some, sums[some]), at, before

        rows, places, scores, row = [], [], [], 0
        none = np.zeros(0, np.int64)
        for high, groups in asked:
            sums = np.zeros(len(ids))
            for x in high:
                sums += dense[x]
            pool, value, least = none, np.zeros(0), 0.0
            if high:
                some = np.flatnonzero(sums > 0)
                if len(some) > most:
                    some = some[sums[some] >= np.partition(sums[some], -most)[-most] - 1e-6]
                if len(some):
                    pool, value, least = top(some, sums[some])
            for middle, queries in groups:
                pool2, value2, least2, at2, before2 = better(sums, middle, pool, least) if middle else (pool, value, least, none, none)
                for rare in queries:
                    if rare:
                        found, best, _, at, before = better(sums, rare, pool2, least2)
                        sums[at] = before
                    else:
                        found, best = pool2, value2
                    if len(found):
                        rows.append(row)
                        places.append(found)
                        scores.append(best)
                    row += 1
                sums[at2] = before2
        for s in range(0, len(rows), 5000):
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in places[s : s + 5000]]))).astype(np.int32))
            best = pa.ListArray.from_arrays(ends, ids.take(pa.array(np.concatenate(places[s : s + 5000]))))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows[s : s + 5000])), best, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(scores[s : s + 5000])))], names=["query_id", "ids", "scores"])

    return run


def _nested(t: pa.Table, n: int) -> tuple:
    """A block of queries ``query_id, x`` of ``code, df``, ordered by their frequent terms: names, codes, weights, which are frequent, the queries."""
    x = t["x"].combine_chunks()
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    size, flat = pc.list_value_length(x).to_numpy(), x.flatten()
    vocabulary, first, term = np.unique(flat.field("code").to_numpy(), return_index=True, return_inverse=True)
    df = flat.field("df").to_numpy()[first]
    kind = (df > OFTEN * n).astype(int) + (df > MIDDLE * n)
    queries = []
    for i, own in enumerate(np.split(term, np.cumsum(size)[:-1])):
        k = kind[own]
        queries.append((*(tuple(np.sort(own[k == c]).tolist()) for c in (2, 1, 0)), i))
    queries.sort(key=lambda q: (q[0], q[1]))
    asked = [(high, [(middle, [q[2] for q in same]) for middle, same in groupby(group, lambda q: q[1])]) for high, group in groupby(queries, lambda q: q[0])]
    names = t["query_id"].combine_chunks()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    return names.take(pa.array([q[3] for q in queries])), vocabulary, np.maximum(1e-6, np.log((n - df + 0.5) / (df + 0.5))), kind == 2, asked


def keyword_search(queries: DataFrame, records: DataFrame, pool: int = 50, stemmed: bool = False, scratch: Scratch | None = None, block: int = 40_000) -> DataFrame:
    """``query_id, id, score, rank``: the best ``pool`` by keywords, ties by id.

    Records meet the queries block by block, and every task of up to ``DOCS`` records keeps its best for each query, so that at most ``pool``
    rows per query and task are shuffled, however many records a query matches.
    """
    spark, scratch = records.sparkSession, scratch or Scratch(records.sparkSession, "keywords")
    terms, hits, n, mean = _hits(queries, records, stemmed, scratch)
    seed = 0  # terms are compared by 64-bit codes, under the first seed that gives no two the same
    while len({*terms.agg(F.count_distinct("term"), F.count_distinct(F.xxhash64("term", F.lit(seed)))).first()}) > 1:
        seed += 1
    code = F.xxhash64("term", F.lit(seed)).alias("code")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // DOCS))
    found = scratch.cut(hits.groupBy("id", "length").agg(F.collect_list(F.struct(code, "tf")).alias("x")).select("id", "length", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs")).repartition(tasks), "found")
    asked = terms.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct(code, "df")).alias("x"))
    # queries with the same frequent terms are in one block, or as many as they fill
    asked = scratch.cut(asked.withColumn("common", F.xxhash64(F.array_sort(F.transform(F.filter("x", lambda t: t["df"] > OFTEN * n), lambda t: t["code"])))), "asked")
    share = asked.groupBy("common").agg(F.ceil(F.count("*") / block).alias("parts"))
    blocks = max(1, -(-asked.count() // block))
    asked = scratch.cut(asked.join(share, "common").select("query_id", "x", F.pmod(F.xxhash64("common", F.pmod(F.xxhash64("query_id"), "parts")), F.lit(blocks)).alias("at")), "asked") if blocks > 1 else asked.withColumn("at", F.lit(0))
    kinds, out = (dict(queries.dtypes)["query_id"], dict(records.dtypes)["id"]), None
    for at in range(blocks):
        rows = asked.where(F.col("at") == at).select("query_id", "x").toArrow()  # one block of queries
        if not rows.num_rows:
            continue
        shared = spark.sparkContext.broadcast(_nested(rows, n))
        part = found.mapInArrow(_best_by_keywords(shared, mean, pool), f"query_id {kinds[0]}, ids array<{kinds[1]}>, scores array<double>")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int")
    out = out.repartition("query_id").select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    return ranked(out.select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score")), pool)


def ranked(scored: DataFrame, most: int | None = None) -> DataFrame:
    """Adds ``rank`` by score, then id, and keeps the best."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return out if most is None else out.where(F.col("rank") <= most)


def bm25_rerank(queries: DataFrame, candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 within each query's own candidates ``query_id, id, rank, text``; repeated query terms count again."""
    words = candidates.select("query_id", "id", scalars.tokens(F.col("text")).alias("words"))
    stats = words.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    tf = words.select("query_id", "id", F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("query_id", "id", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    times = query_terms(queries, repeat=True).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = tf.join(times, ["query_id", "term"]).join(df, ["query_id", "term"]).join(stats, "query_id").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    every = candidates.select("query_id", "id", "rank").join(scored, ["query_id", "id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "id")
    return every.select("query_id", "id", "score", F.row_number().over(w).alias("rank"))


def vector_search(queries: DataFrame, records: DataFrame, most: int = 10, block: int = 2000) -> DataFrame:
    """Exact cosine top list: ``query_id, id, score, rank``. Every batch of records meets the queries as one matrix
    product and keeps its best, so at most ``most`` rows per query and batch are shuffled. Queries are read in blocks of bounded size.
    """
    spark = records.sparkSession
    # the driver holds one block of queries at a time
    n = max(1, -(-queries.count() // block))
    out = None
    for at in range(n):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == at).select("query_id", "vector").collect()
        if not rows:
            continue
        q = np.array([r[1] for r in rows], np.float64)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], q / np.where(size > 0, size, 1)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            names, q = shared.value
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in b["vector"]])
                size = np.linalg.norm(x, axis=1, keepdims=True)
                s = np.round(q @ (x / np.where(size > 0, size, 1)).T, 6)
                ids = b["id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                top = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :most]]
                yield pd.DataFrame({"query_id": np.repeat(names, top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

        part = records.select("id", "vector").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, id {dict(records.dtypes)['id']}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {dict(records.dtypes)['id']}, score double, rank int")
    return ranked(out, most)


def vector_ranks(queries: DataFrame, records: DataFrame, pairs: DataFrame, block: int = 2000) -> DataFrame:
    """``query_id, id, score, rank`` of given pairs ``query_id, id`` among all records, by cosine.

    Every batch of records counts, for each query, its rows above the given scores; the counts are added up. Pairs without a vector drop out.
    """
    spark, kinds = records.sparkSession, dict(records.dtypes)
    a, b = F.transform("qv", lambda x: x.cast("double")), F.transform("vector", lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda t, u: t + u)
    size = lambda x: F.when(dot(x, x) > 0, F.sqrt(dot(x, x))).otherwise(F.lit(1.0))
    joined = pairs.select("query_id", "id").distinct().join(records, "id").join(queries.select("query_id", F.col("vector").alias("qv")), "query_id")
    scored = joined.select("query_id", "id", F.round(dot(a, b) / size(a) / size(b), 6).alias("score"))
    asked = queries.select("query_id", "vector").join(scored.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("score"), F.col("id")))).alias("given")), "query_id")
    n, out = max(1, -(-asked.count() // block)), None
    for at in range(n):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == at).collect()  # one block of queries with their candidates
        if not rows:
            continue
        q = np.array([r["vector"] for r in rows], np.float64)
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        given = [(np.array([g["score"] for g in r["given"]]), [g["id"] for g in r["given"]]) for r in rows]
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], q / np.where(norm > 0, norm, 1), given))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            names, q, given = shared.value
            above = [np.zeros(len(s), np.int64) for s, _ in given]
            for b in batches:
                if not len(b):
                    continue
                x = np.stack([np.asarray(v, np.float64) for v in b["vector"]])
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                t = np.round(q @ (x / np.where(norm > 0, norm, 1)).T, 6)
                ids = b["id"].to_numpy()
                for i, (scores, held) in enumerate(given):
                    order = np.sort(t[i])
                    more = np.searchsorted(order, scores, "right")
                    above[i] += len(order) - more
                    for j in np.flatnonzero(more > np.searchsorted(order, scores, "left")):
                        above[i][j] += int((ids[t[i] == scores[j]] < held[j]).sum())
            yield pd.DataFrame([(name, g, s, a) for name, (ss, gs), aa in zip(names, given, above, strict=True) for g, s, a in zip(gs, ss, aa, strict=True)], columns=["query_id", "id", "score", "above"])

        part = records.select("id", "vector").mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, id {kinds['id']}, score double, above bigint")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id {kinds['id']}, score double, rank int")
    return out.groupBy("query_id", "id", "score").agg((F.sum("above") + 1).cast("int").alias("rank"))


def rrf(keyword: DataFrame, vector: DataFrame, k: int = 60, keyword_weight: float = 1.0, vector_weight: float = 1.0, bonus: float = 0.0) -> DataFrame:
    """Reciprocal ranks of two top lists added up; ``bonus`` adds a share of the best sum times the cosine.

    ``vector`` holds every vector that may end near the top: the best by cosine, and the keyword results with their ranks (``vector_ranks``).
    """
    a = keyword.select("query_id", "id", F.col("rank").alias("r1"))
    b = vector.select("query_id", "id", F.col("rank").alias("r2"), F.col("score").alias("cosine"))
    term = lambda r, w: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", term("r1", keyword_weight) + term("r2", vector_weight))
    best = F.max("score").over(Window.partitionBy("query_id"))
    return ranked(both.select("query_id", "id", F.round(F.col("score") + bonus * best * F.coalesce("cosine", F.lit(0.0)), 6).alias("score")))


def keyword_curve(keyword: DataFrame) -> DataFrame:
    """Scores of a keyword list alone: 1, 4/5, 4/6 ... by rank."""
    return keyword.withColumn("score", F.round(F.lit(4) / (F.lit(3) + F.col("rank")), 6))


def normalise(scored: DataFrame) -> DataFrame:
    """Scores over the query's best; queries whose best is not positive drop out."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return scored.withColumn("_best", best).where("_best > 0").withColumn("score", F.round(F.col("score") / F.col("_best"), 6)).drop("_best")


def relevance(semantic: Column, confidence: Column, strength: Column, recency: Column, graph: Column) -> Column:
    """The weighted sum that orders results."""
    return F.round(0.70 * semantic + 0.10 * confidence + 0.05 * strength + 0.05 * recency + 0.10 * graph, 6)


def interleave(inside: DataFrame, overall: DataFrame) -> DataFrame:
    """Two rankings of a query merged turn by turn, the first one first; each id at its better place."""
    a = inside.select("query_id", "id", (2 * F.col("rank")).alias("place"))
    b = overall.select("query_id", "id", (2 * F.col("rank") + 1).alias("place"))
    one = a.unionByName(b).groupBy("query_id", "id").agg(F.min("place").alias("place"))
    return one.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "id")).alias("rank"))


def evaluate(ranking: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``recall`` and ``ndcg`` at ``k`` of ``query_id, id, rank`` against ``query_id, id``."""
    relevant = relevant.distinct()
    hits = ranking.where(F.col("rank") <= k).join(relevant, ["query_id", "id"])
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    joined = wanted.join(found, "query_id", "left")
    return joined.select("query_id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))
