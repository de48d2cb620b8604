"""Evaluation texts leaking into a corpus, by suffix arrays over the corpus.

The corpus is cut into shards. A match of ``LEAST`` words lies within a run of at least that many words that all
occur in the evaluation texts, so only such runs enter a shard's array; nothing that can match is left out. The shard's
suffixes are sorted by prefix doubling; every suffix of every evaluation text is looked up by binary search, all at
once; around its place lie all corpus suffixes that share its first words. Their common prefixes, extended to the
first difference, are the longest verbatim matches, with places in both texts.

Evaluation texts are read to the driver in blocks of ``BLOCK_CHARS`` characters at most (larger single texts alone), and every block is
searched against the whole corpus.

Defined results: null ids and texts are left out; texts of fewer words than ``LEAST`` match nothing; repeated ids
give one row; of several longest matches the first in the document, then in the item, is reported; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import words

#: Words of the shortest match; corpus words of one suffix array; characters of evaluation text in one block.
LEAST, SHARD_WORDS, BLOCK_CHARS = 12, 1_000_000, 8_000_000
#: Common places of text and query that are extended at once; a single query place may have more.
AT_ONCE = 2_000_000


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` sorted by their first ``depth`` words or more, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    n, k = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:]
        both = rank * (n + 2) + after
        order = np.argsort(both, kind="stable")
        both = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(both[1:] != both[:-1]))) + 1
        k *= 2
        if k >= depth or n < 2 or rank.max() == n:
            return order


def _bound(text: np.ndarray, array: np.ndarray, query: np.ndarray, starts: np.ndarray, after: bool) -> np.ndarray:
    """For each query place: how many suffixes begin below its first ``LEAST`` words (``after``: or with them)."""
    low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(array), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        at = array[np.minimum(mid, len(array) - 1)]
        less, same = np.zeros(len(starts), bool), open_.copy()
        for j in range(LEAST):
            x, y = text[np.minimum(at + j, len(text) - 1)], query[starts + j]
            x = np.where(at + j < len(text), x, -2)
            less |= same & (x < y)
            same &= x == y
        go = open_ & (less | same if after else less)
        low = np.where(go, mid + 1, low)
        high = np.where(open_ & ~go, mid, high)
    return low


def _matches(text: np.ndarray, query: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in text and query of all common runs of ``LEAST`` words and more, and their lengths, in parts of about ``AT_ONCE``."""
    array = suffix_array(text, LEAST)
    low, high = _bound(text, array, query, starts, False), _bound(text, array, query, starts, True)
    part = np.cumsum(high - low) // AT_ONCE
    for p in np.unique(part[high > low]):
        own = (part == p) & (high > low)
        yield _extended(text, query, array, starts[own], low[own], high[own])


def _extended(text: np.ndarray, query: np.ndarray, array: np.ndarray, starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = high - low
    q = np.repeat(starts, n)
    t = array[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    length = np.full(len(q), LEAST)
    going = np.arange(len(q))
    while len(going):
        a, b = t[going] + length[going], q[going] + length[going]
        ok = (a < len(text)) & (b < len(query))
        ok[ok] = (text[a[ok]] == query[b[ok]]) & (query[b[ok]] >= 0)
        going = going[ok]
        length[going] += 1
    return t, q, length


def _search(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, query, items, places, starts = shared.value
        held: list[tuple] = []
        size = 0

        def shard() -> Iterator[pd.DataFrame]:
            text = np.concatenate([x for _, _, w in held for x in (w, [-1])])
            doc = np.repeat(np.arange(len(held)), [len(w) + 1 for _, _, w in held])
            at = np.concatenate([np.arange(s, s + len(w) + 1) for _, s, w in held])
            best = lambda rows: rows.sort_values(["words", "doc_at", "item_at"], ascending=[False, True, True]).drop_duplicates(["doc_id", "item_id"])
            found = [best(pd.DataFrame({"doc_id": [held[d][0] for d in doc[t]], "item_id": items[q], "words": length, "doc_at": at[t], "item_at": places[q]})) for t, q, length in _matches(text, query, starts)]
            if found:
                yield best(pd.concat(found))

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                found = [vocabulary.get(w, -1) for w in words(text)]
                if len(found) < LEAST:
                    continue
                w = np.array(found, np.int64)
                inside = np.concatenate(([0], (w >= 0).view(np.int8), [0]))
                edge = np.flatnonzero(inside[1:] != inside[:-1])
                for a, z in zip(edge[::2], edge[1::2], strict=True):
                    if z - a >= LEAST:
                        held.append((doc, a, w[a:z]))
                        size += z - a + 1
                if size >= SHARD_WORDS:
                    yield from shard()
                    held, size = [], 0
        if held:
            yield from shard()

    return run


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words, doc_at, item_at``: documents with items in them, with the longest match and its places in words."""
    spark = documents.sparkSession
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    rows = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    kinds = {"doc_id": dict(rows.dtypes)["doc_id"], "item_id": dict(items.dtypes)["item_id"]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, words int, doc_at int, item_at int"
    out = None
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        vocabulary: dict[str, int] = {}
        query, ids, places, starts = [], [], [], []
        for item, text in part.collect():
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            starts += range(len(query), len(query) + len(found) - LEAST + 1)
            query += [*found, -3]
            ids += [item] * (len(found) + 1)
            places += range(len(found) + 1)
        if not starts:
            continue
        shared = spark.sparkContext.broadcast((vocabulary, np.array(query), np.array(ids), np.array(places), np.array(starts)))
        found = rows.mapInPandas(_search(shared), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    first = F.max_by(F.struct("words", "doc_at", "item_at"), F.struct("words", -F.col("doc_at"), -F.col("item_at"))).alias("x")
    return out.groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "x.*")


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
