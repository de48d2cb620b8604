"""Hash-chained operation logs: appending, verification, versions.

The hash of an operation covers the hash before it in its log, the action, its data as canonical JSON and its time. A log's order is
``clock, timestamp, id``. Appending is a fold: each log's rows stream through one task in order, none is held. Verification is parallel within a log:
rows are ranged over tasks whatever log they belong to, each task checks its stretch and reports its first and last row, and the
stretches' ends are compared afterwards.

Defined results: operations without a clock are no part of a log; repeated rows count once; a head must have an empty ``prev_hash``;
null data is an empty object, data that is no JSON is hashed as it is; empty logs give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ORDER = ["clock", "timestamp", "id"]


def canonical(data: str | None) -> str:
    """JSON with sorted keys."""
    if data is None:
        return "{}"
    try:
        return json.dumps(json.loads(data), sort_keys=True)
    except ValueError:
        return data


def _time(at: Column) -> Column:
    """ISO text of a time in UTC; no fraction where it is 0."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.unix_micros(at) % 1_000_000 == 0, F.lit("")).otherwise(F.date_format(at, ".SSSSSS")), F.lit("+00:00"))


def operation_hash(before: str, action: str | None, data: str | None, at: str | None) -> str:
    return "sha256:" + hashlib.sha256(f"{before}|{action or ''}|{canonical(data)}|{at or ''}".encode()).hexdigest()


def append(new: DataFrame, heads: DataFrame | None = None, log: str = "author") -> DataFrame:
    """``new`` (log, id, clock, timestamp, action, data) with ``prev_hash, hash``, chained on to ``heads`` (log, hash) where a log has one."""
    kinds = dict(new.dtypes)
    rows = new.where(F.col("clock").isNotNull()).withColumn("_at", _time(F.col("timestamp")))
    rows = rows.join(heads.select(log, F.col("hash").alias("_head")), log, "left") if heads is not None else rows.withColumn("_head", F.lit(None).cast("string"))
    names = [c for c in new.columns if c not in ("prev_hash", "hash")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, before = None, ""
        for b in batches:
            prev, own = [], []
            for name, head, action, data, at in zip(b[log], b["_head"], b["action"], b["data"], b["_at"], strict=True):
                if name != current:
                    current, before = name, head or ""
                prev.append(before)
                before = operation_hash(before, action, data, at)
                own.append(before)
            yield b[names].assign(prev_hash=prev, hash=own)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", prev_hash string, hash string"
    return rows.repartition(log).sortWithinPartitions(log, *_ORDER).mapInPandas(fold, schema)


_STRETCH = "log string, clock bigint, timestamp timestamp, id string, first_prev string, last_hash string, n bigint, n_linked bigint, n_hashed bigint, bad_clock bigint, bad_timestamp timestamp, bad_id string"


def _check(hashes: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict | None = None

        def row(s: dict) -> pd.DataFrame:
            clock, at, name = s["bad"] or (None, pd.NaT, None)
            return pd.DataFrame([(*s["first"], s["before"], s["n"], s["linked"], s["hashed"], clock, at, name)], columns=[c.split()[0] for c in _STRETCH.split(", ")])

        for b in batches:
            for log, clock, ts, name, action, data, at, own, prev in zip(b["log"], b["clock"], b["timestamp"], b["id"], b["action"], b["data"], b["_at"], b["hash"], b["prev_hash"], strict=True):
                new = open_ is None or open_["first"][0] != log
                if new:
                    if open_ is not None:
                        yield row(open_)
                    open_ = {"first": (log, clock, ts, name, prev), "before": None, "n": 0, "linked": 0, "hashed": 0, "bad": None}
                linked = new or open_["before"] == prev
                hashed = not hashes or own == operation_hash(prev or "", action, data, at)
                open_["n"] += 1
                open_["linked"] += linked and not new
                open_["hashed"] += hashed
                if not (linked and hashed) and open_["bad"] is None:
                    open_["bad"] = (clock, ts, name)
                open_["before"] = own
        if open_ is not None:
            yield row(open_)

    return run


def verify(operations: DataFrame, log: str = "author", hashes: bool = True) -> DataFrame:
    """Per log: ``n`` operations, ``n_linked`` whose ``prev_hash`` names the one before, ``n_hashed`` whose hash is right, ``first_broken``."""
    ops = operations.select(F.col(log).cast("string").alias("log"), F.col("clock").cast("bigint").alias("clock"), "timestamp", "id", "action", "data", "hash", "prev_hash").where("log is not null and clock is not null").distinct()
    ops = ops.withColumn("_at", _time(F.col("timestamp")))
    stretch = ops.repartitionByRange("log", *_ORDER).sortWithinPartitions("log", *_ORDER).mapInPandas(_check(hashes), _STRETCH)
    before = F.lag("last_hash", 1, "").over(Window.partitionBy("log").orderBy(*_ORDER))
    joined = stretch.withColumn("joins", F.coalesce(before, F.lit("")).eqNullSafe(F.coalesce("first_prev", F.lit(""))))
    inner = F.when(F.col("bad_clock").isNotNull(), F.struct(F.col("bad_clock").alias("clock"), F.col("bad_timestamp").alias("timestamp"), F.col("bad_id").alias("id")))
    bad = F.when(~F.col("joins"), F.struct(*_ORDER)).otherwise(inner)
    return joined.groupBy("log").agg(F.sum("n").alias("n"), (F.sum("n_linked") + F.count_if("joins")).alias("n_linked"), F.sum("n_hashed").alias("n_hashed"), F.min(bad)["id"].alias("first_broken")).withColumnRenamed("log", log)


def history(operations: DataFrame, blocks: DataFrame) -> DataFrame:
    """The operations of given ``block_id``, in order."""
    return operations.distinct().join(blocks.select("block_id").distinct(), "block_id", "left_semi").orderBy("block_id", F.asc_nulls_first("clock"), "timestamp", "id")


def versions(operations: DataFrame) -> DataFrame:
    """Per block: its operations and the last one."""
    ops = operations.select("id", "block_id", "clock", "timestamp").distinct().where("block_id is not null and block_id <> ''")
    return ops.groupBy("block_id").agg(F.count("*").alias("version"), F.max_by("id", F.struct("clock", "timestamp", "id")).alias("last_op"))
