"""Applying a change feed by associative patch composition.

An operation is a function from a block's state to its state, and any run of operations is one patch:

* ``reset`` - the last create or delete of the run (``none`` without one), after which the state no longer
  depends on what came before;
* ``data`` - the fields set since then (all of a create's, overlaid by later updates);
* ``clock`` - of the last operation that takes effect on a living block.

``then(p, q)`` is ``q`` if ``q`` resets, else ``p`` overlaid by ``q``: associative, so runs can be cut
anywhere. The feed is range-partitioned by block and order, which cuts a hot block into as many chunks as
it needs; each partition folds its chunks to one patch per block, partitions are folded again, and only
blocks on a partition's edge have more than one patch left for the last composition.

Defined results: operations with a null or empty block, a null clock or an unknown action are ignored, as are creates and
updates whose data is no complete JSON object; actions compare without case and outer spaces; order is
clock, timestamp (null first), id (null first); exact repeats change nothing; an empty feed gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATCH = "block_id string, clock0 bigint, ts0 timestamp, id0 string, reset string, data string, clock bigint, touched boolean"
ORDER = ["block_id", "clock0", "ts0", "id0"]


def then(p: list, q: list) -> list:
    """Composition of two patches ``[reset, data, clock, touched]``; ``q`` comes later."""
    if q[0] != "none":
        return q
    if p[0] == "delete" or not q[3]:
        return p
    return [p[0], {**p[1], **q[1]}, q[2], True]


def as_object(data: str | None) -> dict | None:
    """The JSON object in ``data``, or None if it is anything else or incomplete."""
    try:
        found = json.loads(data) if data else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def operation(action: str, data: str | None, clock: int) -> list | None:
    """The patch of one operation; None if it is to be ignored."""
    if action == "delete":
        return ["delete", {}, clock, True]
    if action not in ("create", "update"):
        return None
    found = as_object(data)
    if found is None:
        return None
    return ["create" if action == "create" else "none", found, clock, True]


def _fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Compose neighbouring patches of one block; rows are ``block_id, clock0, ts0, id0, patch``."""
    last = None
    for block, clock0, ts0, id0, patch in rows:
        if last is not None and last[0] == block:
            last[4] = then(last[4], patch)
        else:
            if last is not None:
                yield tuple(last)
            last = [block, clock0, ts0, id0, patch]
    if last is not None:
        yield tuple(last)


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    names, held = ["block_id", "clock0", "ts0", "id0", "reset", "data", "clock", "touched"], []
    for block, clock0, ts0, id0, (reset, data, clock, touched) in rows:
        held.append((block, clock0, ts0, id0, reset, json.dumps(data, ensure_ascii=False), clock, touched))
        if len(held) == 5000:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for block, clock, ts, i, action, data in zip(b.block_id, b.clock0, b.ts0, b.id0, b.action, b.data, strict=True):
                patch = operation(action, data, int(clock))
                if patch is not None:
                    yield block, int(clock), ts, i, patch

    yield from _frames(_fold(rows()))


def _again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for block, clock0, ts0, id0, reset, data, clock, touched in zip(*(b[c] for c in b.columns), strict=True):
                yield block, int(clock0), ts0, id0, [reset, json.loads(data), int(clock), touched]

    yield from _frames(_fold(rows()))


def patches(feed: DataFrame) -> DataFrame:
    """One patch per block and range chunk of ``feed`` (``id, block_id, clock, timestamp, action, data``)."""
    ops = feed.where("block_id is not null and block_id <> '' and clock is not null").select(
        "block_id", F.col("clock").alias("clock0"), F.col("timestamp").cast("timestamp").alias("ts0"), F.col("id").alias("id0"), F.lower(F.trim("action")).alias("action"), "data"
    )
    ops = ops.where(F.col("action").isin("create", "update", "delete")).withColumn("data", F.when(F.col("action") != "delete", F.col("data")))
    return ops.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInPandas(_first, PATCH)


def compose(parts: DataFrame) -> DataFrame:
    """One patch per block: the chunks' patches, at most one per block and range, in order."""
    return parts.repartition("block_id").sortWithinPartitions(*ORDER).mapInPandas(_again, PATCH)


def replay(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``block_id, clock, data`` of the blocks alive after all operations.

    ``base`` holds the same columns from before the feed; its blocks come first in order whatever their clock.
    """
    parts = patches(feed)
    if base is not None:
        first = base.where("block_id is not null and block_id <> ''").select("block_id", F.lit(-(2**63)).alias("clock0"), F.lit(None).cast("timestamp").alias("ts0"), F.lit(None).cast("string").alias("id0"), F.lit("create").alias("reset"), "data", "clock", F.lit(True).alias("touched"))
        parts = first.unionByName(parts)
    return compose(parts).where("reset = 'create'").select("block_id", "clock", "data")
