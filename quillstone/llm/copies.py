"""Copies hidden by formatting: recursive radix partitioning on canonical bytes, then counting tries.

The canonical bytes of a record are its canonical form: the word sequence, or the sorted fields' words. Tasks combine
equal keys before anything is shuffled, so that a record copied into a third of all rows leaves a task as one row for every
``COMBINED`` keys. The radix plan starts with the first bytes of the keys; a bucket of more than ``BUCKET_ROWS`` keys is split by
twice as many bytes, until it fits or its keys end. The plan is a table, joined with the keys level by level. What is
left oversized at the end of its keys is one key; its rows are combined over ``SALTS`` tasks first. Each bucket's
keys go through a compressed trie whose terminals count.

Defined results: null ids and null contents are left out; an id in several rows counts once (smallest key's digest);
contents without any word are all copies of each other; an empty table gives empty results; other columns
are ignored; ties cannot occur, since the kept id is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.words import canonical
from quillstone.plans.scratch import Scratch

#: Keys that one trie may hold; keys combined in memory by one task; bytes of the first level.
BUCKET_ROWS, COMBINED, FIRST = 50_000, 100_000, 2
#: Tasks over which the rows of one key that fills a bucket are combined.
SALTS = 64


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Trie:
    """Counts and smallest ids of byte keys. A node is ``[label, children by first byte, terminal]``; a terminal is ``[key, smallest, n]``."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def add(self, key: bytes, smallest: str, n: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, [key, smallest, n]]
                return
            same = _common(child[0], key[at : at + len(child[0])])
            if same < len(child[0]):
                upper = [child[0][:same], {child[0][same]: child}, None]
                child[0] = child[0][same:]
                node[1][key[at]] = child = upper
            node, at = child, at + same
        if node[2] is None:
            node[2] = [key, smallest, n]
        else:
            node[2][1], node[2][2] = min(node[2][1], smallest), node[2][2] + n

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            _, children, terminal = stack.pop()
            stack.extend(children.values())
            if terminal is not None:
                yield terminal


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "key": [canonical(t).encode("utf-8", "surrogatepass") for t in b["content"]]})


def record_keys(records: DataFrame, scratch: Scratch, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``id, key, digest``: every id once with its canonical bytes. Only ids and digests are shuffled."""
    rows = records.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).where("id is not null and content is not null")
    every = rows.mapInPandas(_keys, "id string, key binary").select("id", "key", F.unhex(F.sha2("key", 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    every = scratch.cut(every, "keys")
    chosen = every.groupBy("id").agg(F.min(F.struct(F.hex("digest").alias("d"), "row")).alias("x"), F.count("*").alias("n")).where("n > 1").select("id", F.col("x.row").alias("chosen"))
    chosen = scratch.cut(chosen, "repeated")
    return every.join(chosen, "id", "left").where("chosen is null or chosen = row").select("id", "key", "digest")


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per key, for every ``COMBINED`` keys."""
    held: dict[bytes, list] = {}

    def done() -> pd.DataFrame:
        return pd.DataFrame([(k, *v) for k, v in held.items()], columns=["key", "keep", "n"])

    for b in batches:
        counts = b["n"] if "n" in b else [1] * len(b)
        for key, name, n in zip(b["key"], b["keep"], counts, strict=True):
            old = held.get(key)
            if old is None:
                held[key] = [name, n]
            else:
                old[0], old[1] = min(old[0], name), old[1] + n
        if len(held) >= COMBINED:
            yield done()
            held = {}
    if held:
        yield done()


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of two and more copies; rows come sorted by bucket."""
    trie, bucket = Trie(), None

    def done() -> Iterator[pd.DataFrame]:
        found = [x for x in trie.terminals() if x[2] > 1]
        if found:
            yield pd.DataFrame(found, columns=["key", "keep", "n"])

    for b in batches:
        for at, key, keep, n in zip(b["bucket"], b["key"], b["keep"], b["n"], strict=True):
            if at != bucket:
                yield from done()
                trie, bucket = Trie(), at
            trie.add(key, keep, n)
    yield from done()


def _buckets(combined: DataFrame, scratch: Scratch, bucket_rows: int) -> DataFrame:
    """``bucket, key, keep, n``: the shortest prefix of each key, of ``FIRST`` bytes and their doubles, whose bucket fits."""
    rest, depth, out = combined, FIRST, None
    while True:
        prefix = F.substring("key", 1, depth)
        counts = rest.groupBy(prefix.alias("bucket")).agg(F.count("*").alias("rows"), F.max(F.length("key")).alias("longest"))
        big = scratch.cut(counts.where(F.col("rows") > bucket_rows).select("bucket", "longest"), "big")
        here = rest.withColumn("bucket", prefix)
        if big.isEmpty():
            return here if out is None else out.unionByName(here)
        ended = big.where(F.col("longest") <= depth).select("bucket")
        fits = here.join(big, "bucket", "left_anti").select("bucket", "key", "keep", "n")
        hot = scratch.cut(here.join(ended, "bucket", "left_semi").repartition(SALTS).select("key", "keep", "n").mapInPandas(_combine, "key binary, keep string, n bigint"), "hot")
        fits = fits.unionByName(hot.select(F.col("key").alias("bucket"), "key", "keep", "n"))
        out = fits if out is None else out.unionByName(fits)
        rest, depth = here.join(big.where(F.col("longest") > depth).select("bucket"), "bucket", "left_semi").select("key", "keep", "n"), 2 * depth


def copies(keys: DataFrame, scratch: Scratch, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """From ``id, key, digest``: the groups ``digest, keep, n`` of two and more, and the copies ``keep_id, copy_id``."""
    combined = keys.select("key", F.col("id").alias("keep")).mapInPandas(_combine, "key binary, keep string, n bigint")
    combined = scratch.cut(combined, "combined")
    counted = _buckets(combined, scratch, bucket_rows).repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_count, "key binary, keep string, n bigint")
    groups = scratch.cut(counted.select(F.unhex(F.sha2("key", 256)).alias("digest"), "keep", "n"), "groups")
    found = keys.select("id", "digest").join(groups, "digest").where("id <> keep").select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id"))
    return groups, found
