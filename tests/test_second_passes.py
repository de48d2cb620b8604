"""Rerankers, several hops, encryption."""

from pyspark.sql import functions as F

from quillstone.functions import secrets
from quillstone.operators import rerank
from quillstone.plans.scratch import Scratch


def test_heuristic_prefers_quotes_and_names(spark):
    queries = spark.createDataFrame([("q", 'who keeps "red box" near Ann')], "query_id string, text string")
    rows = spark.createDataFrame([("q", "a", 1, "nothing"), ("q", "b", 2, "the red box is kept near ann"), ("q", "c", 3, None)], "query_id string, id string, rank int, text string")
    assert [r.id for r in rerank.heuristic(queries, rows).orderBy("rank").collect()][0] == "b"
    assert [r.id for r in rerank.by_function(rows, lambda p: p["rank"]).orderBy("rank").collect()] == ["c", "b", "a"]


def test_hops(spark):
    records = spark.createDataFrame([("a", "Ann met Bob Stone at the harbor"), ("b", "Bob Stone likes plums"), ("c", "quiet"), ("d", "rain")], "id string, text string").withColumns({"type": F.lit("fact"), "strength": F.lit(0.0)})
    live = spark.createDataFrame([("a", "c"), ("c", "a")], "a string, b string")
    asked = spark.createDataFrame([("q", "harbor"), ("r", "zzz Plums"), ("e", "zzz")], "query_id string, text string")
    found = rerank.multi_hop(asked, records, live, Scratch(spark, "t"))
    assert [(r.query_id, r.id, r.hop) for r in found.orderBy("query_id", "rank").collect()] == [("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "b", 1), ("r", "a", 2), ("r", "c", 3)]


def test_encryption_round_trip(spark):
    salt = b"0123456789abcdef"
    good, bad = secrets.key("open", salt), secrets.key("shut", salt)
    df = spark.createDataFrame([("tëxt",), ("",), (None,)], "t string").withColumn("e", secrets.encrypted(F.col("t"), good, salt))
    rows = df.select("t", "e", secrets.decrypted(F.col("e"), good).alias("d"), secrets.decrypted(F.col("e"), bad).alias("x"), secrets.signature(F.col("t")).alias("s")).collect()
    assert [r.d for r in rows] == ["tëxt", "", None] and rows[0].x is None and rows[0].e != "tëxt" and rows[0].s.startswith("sha256:")
