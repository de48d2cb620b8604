"""Retrieval queries against their SQL, and what SQL cannot express against brute force or small cases."""

import math
import pathlib
import random
import tempfile
from collections import Counter
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.functions import phrases, scalars
from quillstone.functions.stem import stem
from quillstone.operators import context, graph, records, retrieval
from quillstone.plans.scratch import Scratch
from quillstone.sources import snapshot
from quillstone.streaming import live


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in pathlib.Path(small).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, small, sql, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    found = sql.sql(entry.oracle_sql()[name])
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_composed_hash(spark):
    df = spark.createDataFrame([("Café  au\tlait ",), ("café AU LAIT",), (None,)], "t string")
    found = [r[0] for r in df.select(scalars.content_hash(df.t)).collect()]
    assert found[0] == found[1] and found[2] is None


def test_budget_and_greedy(spark):
    rows = spark.createDataFrame([("q", "a", 1, 5), ("q", "b", 2, 50), ("q", "c", 3, 4), ("r", "d", 1, 100)], "query_id string, id string, rank int, cost bigint")
    assert [r.id for r in context.within_budget(rows, 20).collect()] == ["a"]
    assert [r.id for r in context.greedy(rows, 10).orderBy("n").collect()] == ["a", "c"]


def test_chunks(spark):
    text = "\n\n".join("x" * n for n in (900, 900, 900, 2500, 10)) + "\n \n"
    found = records.chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").collect()
    assert [(r.id, len(r.chunk)) for r in found] == [(1, 1802), (1, 900), (1, 2500), (1, 10)]


def test_paths_cross_deleted_records_and_traversal_does_not(spark):
    edges = spark.createDataFrame([("1", "a", "b", "r", 1.0), ("2", "b", "c", "r", 1.0), ("3", None, "c", "r", 1.0), ("4", "c", "d", "r", None)], "id string, source_id string, target_id string, relation string, weight double")
    blocks = spark.createDataFrame([("a", False), ("b", True), ("c", False), ("d", False)], "id string, deleted boolean")
    scratch = Scratch(spark, "t")
    assert graph.shortest_path("a", "d", edges, scratch) == ["a", "b", "c", "d"]
    assert graph.shortest_path("a", "a", edges, scratch) == ["a"] and graph.shortest_path("a", "z", edges, scratch) == []
    found = graph.traverse(spark.createDataFrame([("a",), ("d",)], "id string"), graph.live_edges(edges, blocks), scratch)
    assert {tuple(r) for r in found.collect()} == {("d", "c", 1)}


def test_vector_ties_zero_vectors_and_empty_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<float>")
    assert [(r.id, r.score, r["rank"]) for r in retrieval.vector_search(q, v, 3).orderBy("rank").collect()] == [(1, 1.0, 1), (2, 1.0, 2), (3, 0.0, 3)]
    assert retrieval.vector_search(q.limit(0), v, 3).count() == 0


def test_upsert_and_touch(spark):
    b = spark.createDataFrame([("a", 1, False, 0, None), ("b", 2, False, 1, datetime(2024, 1, 1))], "id string, version int, deleted boolean, access_count int, last_accessed timestamp")
    new = spark.createDataFrame([("a", 1, False, 9, None), ("b", 1, True, 9, None), ("c", 1, False, 0, None)], b.schema)
    assert {(r.id, r.access_count) for r in records.upsert(b, new).collect()} == {("a", 9), ("b", 1), ("c", 0)}
    at = spark.createDataFrame([("a", datetime(2025, 1, 1)), ("a", datetime(2025, 1, 2))], "id string, at timestamp")
    assert {(r.id, r.access_count, r.last_accessed) for r in records.touch(b, at).collect()} == {("a", 2, datetime(2025, 1, 2)), ("b", 1, datetime(2024, 1, 1))}


def test_snapshot_round_trip_and_tampering(spark, small):
    t = {n: spark.read.parquet(f"{small}/{f}.parquet") for n, f in (("blocks", "blocks"), ("edges", "edges"), ("embeddings", "block_embeddings"), ("operations", "operations"))}
    with tempfile.TemporaryDirectory() as d:
        snapshot.write(f"{d}/s", **t)
        back = snapshot.read(spark, f"{d}/s")
        assert back["blocks"].count() == t["blocks"].count()
        some = {n: df.limit(5) if n == "blocks" else df.limit(0) for n, df in t.items()}
        assert snapshot.merge(some, back)["blocks"].select("id").distinct().count() == t["blocks"].select("id").distinct().count()
        t["edges"].limit(1).write.mode("append").parquet(f"{d}/s/edges")
        with pytest.raises(ValueError, match="edges"):
            snapshot.read(spark, f"{d}/s")
    assert snapshot.markdown(t["blocks"].limit(3), t["edges"]).count() == 3


def test_phrases(spark):
    now = datetime(2025, 3, 12, 15, 30)
    said = {
        "what happened yesterday?": (datetime(2025, 3, 11), datetime(2025, 3, 12), "what happened ?"), "notes of 2 weeks ago": (datetime(2025, 2, 24), datetime(2025, 2, 28, 15, 30), "notes of"),
        "in December 2024": (datetime(2024, 12, 1), datetime(2025, 1, 1), "in December 2024"), "bugs before 2024": (None, datetime(2024, 1, 1), "bugs"), "after March notes": (datetime(2025, 4, 1), None, "notes"),
        "last wednesday": (datetime(2025, 3, 5), datetime(2025, 3, 6), "last wednesday"), "last year or last week": (datetime(2025, 3, 5), now, "or"), "in 2023 and in May": (datetime(2025, 5, 1), datetime(2025, 6, 1), "and"),
    }
    df = spark.createDataFrame([(t, now) for t in [*said, "whatever", None]], "t string, now timestamp").select("t", phrases.time_window(F.col("t"), F.col("now")).alias("w"))
    assert {r.t: r.w and tuple(r.w) for r in df.collect()} == said | {"whatever": None, None: None}


def test_follow_ups(spark):
    cases = [
        ("tell me more", ["I use Apache Spark", "ok"], "tell me more about Apache Spark"), ("Why is that?", ["HDFC Top and the Parag Parikh Flexi Cap", "thanks"], "why Parag Parikh Flexi Cap"), ("go on", ["we compared index funds today"], "more about compared index funds today"),
        ("what about it?", ["Thanks"], "what about it?"), ("why does it rain?", ["Apache Spark"], "why does it rain?"), ("compare them", ["Alpha One", "b", "c", "d"], "compare them"), ("tell me more", [], "tell me more"), ("explain", None, "explain"), (None, ["X Yz"], None),
    ]
    df = spark.createDataFrame([(q, r) for q, r, _ in cases], "q string, r array<string>").select(phrases.whole_question(F.col("q"), F.col("r")).alias("w"))
    assert [r.w for r in df.collect()] == [w for *_, w in cases]


def test_noise_and_keys(spark):
    texts = {"Hello!": True, "sure.": True, "ok": True, "test": False, "Why?": False, "a?": True, "THANK YOU": True, "what is x": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.is_noise(F.col("t")).alias("n"), scalars.is_noise(F.col("t"), ["test"], ["sure"]).alias("m"))
    rows = df.collect()
    assert {r.t: r.n for r in rows} == texts and {r.t: r.m for r in rows} == texts | {"test": True, "sure.": False}
    keys = spark.createDataFrame([("  Cafe\u0301  IS open?! ",), ("caf\u00e9 is open",)], "t string").select(scalars.question_text(F.col("t"))).collect()
    assert keys[0][0] == keys[1][0] == "caf\u00e9 is open"


def test_stems():
    words = {"running": "run", "caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "filing": "file", "relational": "relat", "happy": "happi", "generalizations": "gener", "sky": "sky", "is": "is", "controlling": "control", "tree": "tree", "1ing": "1ing"}
    assert {w: stem(w) for w in words} == words


def test_streams(spark):
    with tempfile.TemporaryDirectory() as d:
        schema = "session_id string, n bigint, failed boolean"
        for i, part in enumerate([[("a", 1, True), ("a", 2, True), ("b", 1, True)], [("a", 3, True), ("b", 2, False), ("a", 4, True)]]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{d}/calls/{i}")
        calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{d}/calls")
        q = live.trouble(calls).writeStream.format("memory").queryName("trouble").option("checkpointLocation", f"{d}/c1").trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert [tuple(r) for r in spark.table("trouble").collect()] == [("a", 3)]
        schema = "key string, kind string, ref_table string, ref_field string, at timestamp, n bigint"
        t = datetime(2024, 5, 2)
        spark.createDataFrame([("k", "ref", "e", "f", t, 1), ("k", "ref", "e", "f", t, 2), ("m", "ref", "e", "f", t, 1), ("m", "parent", None, None, t, 2), ("z", "parent", None, None, t, 1), ("z", "ref", "e", "g", None, 2), ("z", "delete", None, None, None, 3), ("y", "delete", None, None, None, 1), ("y", "parent", None, None, datetime(2025, 1, 1), 2), ("y", "ref", "e", "f", t, 3)], schema).coalesce(1).write.parquet(f"{d}/refs")
        events = spark.readStream.schema(schema).parquet(f"{d}/refs")
        q = live.orphans(events).writeStream.format("memory").queryName("waiting").outputMode("update").option("checkpointLocation", f"{d}/c2").trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert {tuple(r) for r in spark.table("waiting").collect()} == {("k", "e", "f", "2024-05", "absent", 2), ("z", "e", "g", None, "deleted", 1), ("y", "e", "f", "2024-05", "early", 1)}


def test_stateful_streams(spark):
    with tempfile.TemporaryDirectory() as d:

        def stream(rows, schema, name, make):
            for i, part in enumerate(rows):
                spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{d}/{name}/{i}")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{d}/{name}")
            make(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{d}/c-{name}").trigger(availableNow=True).start().awaitTermination(90)
            return {tuple(r) for r in spark.table(name).collect()}

        calls = [[("a", 1, "f", "{}", "Error", None), ("a", 2, "f", "{}", "fine", None), ("b", 1, "g", None, "[]", None)], [("a", 3, "f", "{}", "fine", None), ("b", 2, "g", None, "", None)]]
        assert stream(calls, "session_id string, n bigint, name string, arguments string, content string, is_error boolean", "stuck", live.stuck) == {("a", 3, "repeats"), ("b", 2, "empties")}
        lines = [[("a", 1, "x"), ("a", 2, "y")], [("a", 3, "z"), ("a", 4, "u"), ("b", 1, "v")]]
        assert stream(lines, "session_id string, n bigint, line string", "every", lambda m: live.every(m, 2)) == {("a", 0, "x\ny"), ("a", 1, "z\nu")}
        at = lambda h: datetime(2025, 1, 1, h)
        events = [[("k", at(1), 3600), ("m", at(1), 36000)], [("z", at(9), 10)], [("z", at(10), 10)]]
        assert stream(events, "key string, at timestamp, ttl bigint", "expired", live.expired) == {("k", at(2))}


def test_windows_of_streams_equal_batches(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").selectExpr("'o' as org_id", "event_type as question", "user_id", "cast(ts as timestamp) as asked_at", "cast(ts as timestamp) as ts", "cast(event_id as string) as receipt")
    assert live.per_day(e).selectExpr("sum(n)").first()[0] == e.count()
    assert live.sessions(e).selectExpr("sum(n)").first()[0] == e.count()
    assert live.recent_rate(e).count() > 0 and live.running_counters(e).count() == 5
    with tempfile.TemporaryDirectory() as d:
        e.coalesce(1).write.parquet(f"{d}/e")
        q = live.first_asks(spark.readStream.schema(e.schema).parquet(f"{d}/e"), "1000 days").writeStream.format("memory").queryName("first_asks").option("checkpointLocation", f"{d}/c").trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert spark.table("first_asks").count() == e.select("org_id", "question", "user_id").distinct().count()


@pytest.mark.parametrize("block", [3, 1000])
def test_keyword_search_equals_brute_force_and_shuffles_one_row_per_query_and_task(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "MIDDLE", 0.05)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    texts = [(f"r{i:03}", " ".join(rng.choices(words, [1 / (1 + k) for k in range(30)], k=rng.choice([2, 5, 9])))) for i in range(300)]
    records = spark.createDataFrame([*texts, ("same", texts[7][1]), ("none", None)], "id string, text string").repartition(2)
    asked = spark.createDataFrame([*texts[:40], ("unknown", "zz"), ("rare", "w29 w28 zz"), ("often", "w0 w0")], "query_id string, text string")
    found = retrieval.keyword_search(asked, records, 4, block=block)
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in found.collect()}
    scores = retrieval.keyword_scores(asked, records)
    want = {(r.query_id, r.id): (r.score, r["rank"]) for r in retrieval.ranked(scores, 4).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == v[1] and abs(got[k][0] - v[0]) < 1e-5 for k, v in want.items()) and len(got) > 150
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ids#" in plan and "scores#" in plan  # whole lists, not rows of small batches, are shuffled
