"""``python -m quillstone.cli``: statistics, keyword queries, pruning and export over a data folder or a store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import __version__
from quillstone.operators import compose, lifecycle, records
from quillstone.plans.scratch import Scratch
from quillstone.sources import snapshot, store, tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstone")
    p.add_argument("--data", default=".", help="folder of Parquet tables, or a store's folder")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("init")
    sub.add_parser("stats")
    q = sub.add_parser("query")
    q.add_argument("text")
    q.add_argument("--limit", type=int, default=10)
    q.add_argument("--type")
    q.add_argument("--as-of", required=True)
    r = sub.add_parser("prune")
    r.add_argument("--as-of", required=True)
    r.add_argument("--threshold", type=float, default=0.1)
    r.add_argument("--apply", action="store_true", help="write the deletions; else they are only listed")
    e = sub.add_parser("export")
    e.add_argument("--format", choices=["json", "markdown"], default="json")
    e.add_argument("--out", required=True)
    return p


def run(args: list[str], spark: SparkSession) -> DataFrame | None:
    """The result of a command; what it prints is its rows."""
    a = _parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return None
    opened = store.Store(spark, a.data)
    if a.command == "init":
        if not opened.version():
            t = opened.begin()
            for name, schema in snapshot.SCHEMAS.items():
                t.stage(name, spark.createDataFrame([], schema))
            t.publish()
        return None
    read = opened.table if opened.version() else lambda name: tables.table(spark, a.data, "block_embeddings" if name == "embeddings" else name)
    blocks = records.latest(read("blocks"))
    if a.command == "stats":
        return records.statistics(blocks, read("edges"), read("operations"), read("embeddings"))
    if a.command == "query":
        asked = spark.createDataFrame([("q", a.text)], "query_id string, text string")
        found = compose.search(asked, blocks, a.as_of, Scratch(spark, "cli"), limit=a.limit, type=a.type)
        return found.join(blocks.select("id", "type", "content"), "id").orderBy("rank").select("rank", "relevance", "id", "type", "content")
    if a.command == "prune":
        weak = records.prune_candidates(blocks, a.as_of, a.threshold)
        if a.apply:
            if not opened.version():
                raise SystemExit("only a store can be changed")

            def change(t: store.Transaction) -> None:
                after = lifecycle.prune(lifecycle.Tables(blocks, read("edges"), read("embeddings")), weak, Scratch(spark, "cli"))
                t.stage("blocks", after.blocks)
                t.stage("edges", after.edges)
                t.stage("embeddings", after.embeddings)

            opened.write(change)
        return weak
    rows = store.json_lines(blocks) if a.format == "json" else snapshot.markdown(blocks, read("edges")).select(F.col("text").alias("value"))
    rows.write.text(a.out)
    return None


def main() -> None:
    spark = SparkSession.builder.appName("quillstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = run(sys.argv[1:], spark)
    if found is not None:
        found.show(100, truncate=100)


if __name__ == "__main__":
    main()
