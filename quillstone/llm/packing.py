"""Filling containers of fixed capacity by sum-of-squares online packing.

Lengths are tokens of a public tokenizer. A text longer than the capacity fills whole containers alone; its rest is
an item like every other text. Items are packed shard by shard, online: of the partly filled containers that still have
room (and a new one), the item goes where the sum over all fill levels of the squared number of containers at
that level grows least, ties to the fullest. An array holds the numbers by level, so an item costs one pass over the levels whatever
the shard holds. What a shard leaves partly filled is packed again as items by the next round's fewer
shards, until one shard is left; containers are merged there, never opened.

Defined results: null ids and null texts are left out; an empty text is an item of no tokens and goes into any open container;
repeated ids are items of their own; capacities below 1 and null ones are refused by a ``ValueError``; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.scratch import Scratch

#: Default vocabulary: byte-level BPE ranks for many languages; its folder is installed beside the tokenizers' libraries.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one shard, and shards packed again by one.
SHARD_ITEMS, FAN_IN = 20_000, 16
#: Capacities up to this number are broadcast.
BROADCAST_BUDGETS = 10_000

_ENCODERS: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, tokens``: the number of tokens of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(vocabulary).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(encode(t)) for t in b["text"]]})

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, tokens bigint")


class Levels:
    """Sum-of-squares packing into containers of one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, size: int) -> int:
        """The number of the container that the item of ``size`` goes into."""
        if size == 0:
            level = int(self.count.nonzero()[0][-1]) if self.open else -1
            if level > 0:
                return self.open[level][-1]
        at, count = -1, self.count
        best = 2 * count[size] + 1 if 0 < size < self.capacity else 0
        levels = count[1 : self.capacity - size + 1].nonzero()[0] + 1
        if len(levels):
            cost = 2 * (count[levels + size] - count[levels]) + 2
            if levels[-1] + size == self.capacity:
                cost[-1] = 1 - 2 * count[levels[-1]]
            k = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[k] <= best:
                at = int(levels[k])
        if at < 0:
            box, at, self.made = self.made, 0, self.made + 1
        else:
            box = self.open[at].pop()
            count[at] -= 1
            if not self.open[at]:
                del self.open[at]
        level = at + size
        if 0 < level < self.capacity:
            count[level] += 1
            self.open.setdefault(level, []).append(box)
        return box

    def levels(self) -> dict[int, int]:
        """Fill of every container that is not full."""
        return {box: level for level, boxes in self.open.items() for box in boxes}


OUT = "budget_id bigint, capacity int, box string, level int, item string"


def _pack(prefix: str) -> Callable:
    """Packs each shard's items; rows are sorted by shard. ``level`` is the box's fill at the shard's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packs, rows = None, {}, []

        def done() -> Iterator[pd.DataFrame]:
            fill = {k: p.levels() for k, p in packs.items()}
            out = [(k[0], k[1], f"{prefix}{shard}:{box}", fill[k].get(box, k[1]), item) for k, box, item in rows]
            for s in range(0, len(out), 20_000):
                yield pd.DataFrame(out[s : s + 20_000], columns=["budget_id", "capacity", "box", "level", "item"]).astype({"box": object, "item": object})

        for b in batches:
            for at, budget, capacity, item, size in zip(b["shard"], b["budget_id"], b["capacity"], b["item"], b["size"], strict=True):
                if at != shard:
                    yield from done()
                    shard, packs, rows = at, {}, []
                key = (int(budget), int(capacity))
                if key not in packs:
                    packs[key] = Levels(key[1])
                rows.append((key, packs[key].place(int(size)), item))
        yield from done()

    return run


def pack(counts: DataFrame, budgets: DataFrame, scratch: Scratch, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """From ``id, tokens`` and ``budget_id, capacity_tokens``: ``budget_id, container, id, piece, first_token, tokens``."""
    if budgets.where("capacity_tokens is null or capacity_tokens < 1").head(1):
        raise ValueError("a capacity must be at least 1")
    counts = scratch.cut(counts.withColumn("row", F.monotonically_increasing_id()), "counts")
    n = counts.count()
    some = budgets.select(F.col("budget_id").cast("bigint").alias("budget_id"), F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    # a stated set of capacities against all texts: every capacity packs every text
    some = F.broadcast(some) if some.count() <= BROADCAST_BUDGETS else some
    each = counts.join(some, how="cross").withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")))
    filled = each.where("whole > 0").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    filled = filled.select("budget_id", F.concat(F.lit("d"), "row", F.lit("."), "piece").alias("container"), "id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("long").alias("tokens"))
    rest = each.where("tokens = 0 or tokens % capacity > 0").withColumn("size", (F.col("tokens") % F.col("capacity")).cast("int"))
    items = rest.select("budget_id", "capacity", F.concat(F.lit("i"), "row").alias("item"), "size")
    shards, round_, home = max(1, -(-n // shard_items)), 0, None
    while True:
        sharded = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(round_)), F.lit(shards)).cast("int"))
        placed = scratch.cut(sharded.repartition(min(shards, 4000), "shard").sortWithinPartitions("shard", "budget_id", F.xxhash64("item")).mapInPandas(_pack(f"r{round_}."), OUT), "placed")
        moved = placed.select("budget_id", "item", F.col("box").alias("to"))
        home = moved if home is None else home.join(moved.withColumnRenamed("item", "via"), (home["budget_id"] == moved["budget_id"]) & (F.col("now") == F.col("via")), "left").select(home["budget_id"], home["item"], F.coalesce("to", "now").alias("to"))
        home = home.select("budget_id", "item", F.col("to").alias("now"))
        if shards == 1:
            break
        items = placed.where("level < capacity").groupBy("budget_id", "capacity", F.col("box").alias("item")).agg(F.first("level").alias("size"))
        shards, round_ = max(1, -(-shards // FAN_IN)), round_ + 1
    home = home.withColumn("row", F.substring("item", 2, 20).cast("long")).select("budget_id", "row", "now")
    placed = rest.join(home, ["budget_id", "row"]).select("budget_id", F.col("now").alias("container"), "id", F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity")).alias("first_token"), F.col("size").cast("long").alias("tokens"))
    return filled.unionByName(placed)
