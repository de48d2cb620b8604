"""Writes: edges, lifecycle, log, versions, duplicates under a policy, callers' models."""

import json
import tempfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone import cli
from quillstone.operators import context, dedup, entities, graph, lifecycle, links, oplog, providers, rerank, retrieval, session, trouble
from quillstone.plans.scratch import Scratch
from quillstone.sources import snapshot, store

AT = datetime(2025, 1, 1)
BLOCK = "id string, type string, content string, tags array<string>, parent_id string, children_ids array<string>, version int, content_hash string, deleted boolean, confidence double, created_at timestamp"
EDGE = "id string, source_id string, target_id string, relation string, weight double, created_at timestamp"


def block(i, kind="fact", up=None, down=(), deleted=False, content=None, tags=(), confidence=0.5):
    return (i, kind, content or f"text {i}", list(tags), up, list(down), 1, None, deleted, confidence, AT)


@pytest.fixture
def tables(spark):
    b = spark.createDataFrame([block("r", "entity", None, ["a"]), block("a", "entity", "r", ["b", "c"]), block("b", "entity", "a", ["d"]), block("c", "fact", "a"), block("d", "fact", "b"), block("x", "event", None, deleted=True)], BLOCK)
    e = spark.createDataFrame([("1", "a", "b", "supports", 1.0, AT), ("2", "c", "d", "supports", 1.0, AT), ("3", "r", None, "supports", None, AT)], EDGE)
    v = spark.createDataFrame([(i, [1.0, float(n)]) for n, i in enumerate("abcd")], "block_id string, embedding array<float>")
    return lifecycle.Tables(b, e, v)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_deletions_move_children_up_or_take_them_along(spark, tables):
    scratch, gone = Scratch(spark, "t"), spark.createDataFrame([("a",), ("b",), ("zz",), ("x",)], "id string")
    up = lifecycle.soft_delete(tables, gone, scratch)
    rows = {r.id: r for r in up.blocks.collect()}
    assert rows["c"].parent_id == rows["d"].parent_id == "r" and rows["r"].children_ids == ["c", "d"] and rows["a"].deleted and not rows["d"].deleted
    assert ids(up.edges) == ["2", "3"] and ids(up.embeddings, "block_id") == ["c", "d"] and ids(up.operations, "block_id") == ["a", "b"]
    all_ = lifecycle.soft_delete(tables, gone.where("id = 'a'"), scratch, cascade=True)
    assert ids(all_.blocks.where("deleted")) == ["a", "b", "c", "d", "x"] and ids(all_.edges) == ["3"]
    hard = lifecycle.hard_delete(tables, gone, scratch)
    assert ids(hard.blocks) == ["c", "d", "r"] and {r.id: r.parent_id for r in hard.blocks.collect()}["d"] == "r"


def test_update_and_move(spark, tables):
    changes = spark.createDataFrame([("c", "new text", None), ("x", "no", None), ("d", None, 0.9), ("d", None, 0.8)], "id string, content string, confidence double")
    after = lifecycle.update(tables, changes)
    rows = {r.id: r for r in after.blocks.collect()}
    assert (rows["c"].content, rows["c"].version, rows["d"].confidence, rows["d"].version, rows["x"].version, rows["a"].version) == ("new text", 2, 0.9, 2, 1, 1)
    assert len(rows["c"].content_hash) == 64 and ids(after.embeddings, "block_id") == ["a", "b", "d"] and ids(after.operations, "block_id") == ["c", "d"]
    moves = spark.createDataFrame([("c", "r"), ("a", "b"), ("d", "c"), ("q", "r"), ("b", "nowhere")], "id string, parent_id string")
    moved, refused = lifecycle.move(tables, moves.where("id <> 'd'").unionByName(moves.where("id = 'd'").withColumn("parent_id", F.lit("c"))), Scratch(spark, "t"))
    assert {r.id: r.rule for r in refused.collect()} == {"a": "parent is below the record", "q": "record does not exist", "b": "parent does not exist"}
    rows = {r.id: r for r in moved.blocks.collect()}
    assert rows["c"].parent_id == "r" and sorted(rows["r"].children_ids) == ["a", "c"] and rows["a"].children_ids == ["b"] and rows["d"].parent_id == "c"
    assert {(r.id, r.rule) for r in lifecycle.parent_violations(tables.blocks.withColumn("parent_id", F.when(F.col("id") == "c", "d").when(F.col("id") == "d", "zz").otherwise(F.col("parent_id")))).collect()} == {("d", "parent does not exist")}


def test_links(spark, tables):
    new = spark.createDataFrame([("1", "a", "c", "supports", 0.5), ("9", "c", "a", "about", 0.5), ("8", "a", "c", "about", 0.5), ("7", "a", "x", "supports", 0.5), ("6", "a", "c", "supports", 2.0), ("5", "c", "d", "caused_by", 0.1)], "id string, source_id string, target_id string, relation string, weight double")
    edges, operations, refused = links.link(tables.edges, new, tables.blocks, "2025-02-02")
    assert {(r.id, r.target_id) for r in edges.collect()} == {("1", "c"), ("2", "d"), ("3", None), ("9", "a")} and ids(operations, "action") == ["link", "link"]
    assert ids(refused) == ["5", "6", "7", "8"]
    left, removed = links.unlink(edges, spark.createDataFrame([("c", "d", "about"), ("a", "c", None)], "source_id string, target_id string, relation string"))
    assert ids(left) == ["2", "3", "9"] and [tuple(r) for r in removed.collect()] == [("a", "c", 1)]
    assert ids(links.between(edges, spark.createDataFrame([("c", "d")], "source_id string, target_id string"))) == ["2"]


def test_log_is_sealed_continued_and_verified(spark):
    ops = spark.createDataFrame([(log, f"{log}{n:03}", n, datetime(2025, 1, 1, 0, 0, n % 60), "create", json.dumps({"b": n, "a": [1, "é"]})) for log in ("p", "q") for n in range(60)], "author string, id string, clock bigint, timestamp timestamp, action string, data string")
    first = oplog.append(ops.where("clock < 40"))
    heads = first.groupBy("author").agg(F.max_by("hash", "clock").alias("hash"))
    log = first.unionByName(oplog.append(ops.where("clock >= 40"), heads))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    sound = {tuple(r) for r in oplog.verify(log).collect()}
    broken = {r.author: (r.n, r.n_linked, r.n_hashed, r.first_broken) for r in oplog.verify(log.where("id <> 'p000'").withColumn("data", F.when(F.col("id") == "q030", "{}").otherwise(F.col("data")))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sound == {("p", 60, 60, 60, None), ("q", 60, 60, 60, None)}
    assert broken == {"p": (59, 58, 59, "p001"), "q": (60, 60, 59, "q030")}
    assert oplog.operation_hash("", "a", '{"b": 1, "a": 2}', "t") == oplog.operation_hash("", "a", '{"a":2,"b":1}', "t")


def test_versions_receipts_conflicts_and_recovery(spark):
    with tempfile.TemporaryDirectory() as d:
        s = store.Store(spark, f"file://{d}/s")
        rows = lambda *n: spark.createDataFrame([(x,) for x in n], "x int")
        t = s.begin("w1")
        t.stage("blocks", rows(1))
        assert s.status("w1") == "pending" and s.version() == 0
        late = s.begin()
        late.stage("blocks", rows(9))
        assert t.publish() == 1 and s.status("w1") == "applied" and s.status("w2") == "unknown"
        with pytest.raises(store.Conflict):
            late.publish()
        late.abort()
        add = lambda t: t.stage("blocks", t.table("blocks").unionByName(rows(2)))
        assert s.write(add, "w2") == 2 and s.write(add, "w2") == 2 and s.table("blocks").count() == 2 and s.table("blocks", 1).count() == 1
        with pytest.raises(ZeroDivisionError):
            s.write(lambda t: t.stage("blocks", rows(1 // 0)))
        dead = s.begin(lease=-1)
        dead.stage("edges", rows(5))
        assert s.recover() == [dead.name] and s.files.names("open") == [] and s.version() == 2
        assert s.identity("m:64") == "m:64" and s.table("blocks").count() == 2
        with pytest.raises(ValueError, match="m:64"):
            s.identity("other")
        assert s.fork(f"file://{d}/f").table("blocks").count() == 2


def test_restore_modes(spark, tables):
    snap = {"blocks": tables.blocks, "edges": tables.edges, "embeddings": tables.embeddings, "operations": spark.createDataFrame([], snapshot.SCHEMAS["operations"])}
    empty = {n: df.limit(0) for n, df in snap.items()}
    assert snapshot.restore(empty, snap, "empty")["edges"].count() == 2
    with pytest.raises(ValueError, match="not empty"):
        snapshot.restore(snap, snap, "empty")
    with pytest.raises(ValueError, match="do not fit"):
        snapshot.restore(empty, snap, models=("a", "b"))
    assert snapshot.restore(empty, snap, embeddings="drop", models=("a", "b"))["embeddings"].count() == 0
    again = lambda rows: rows.select(F.col("id").alias("block_id"), F.array(F.lit(0.5).cast("float")).alias("embedding"))
    assert snapshot.restore(empty, snap, embeddings="reembed", models=("a", "b"), reembed=again)["embeddings"].count() == 6


def test_duplicates_under_policies(spark):
    known = spark.createDataFrame([block("k", content="Same  text", tags=["u"], confidence=0.2), block("g", content="gone", deleted=True)], BLOCK)
    new = spark.createDataFrame([block("m", content="same text", tags=["v"], confidence=0.9), block("n", content="same TEXT", tags=["u", "w"]), block("o", content="gone"), block("p", content="other")], BLOCK)
    written, stored = dedup.store(new, known)
    assert ids(written) == ["o", "p"] and {tuple(r) for r in stored.collect()} == {("m", "k"), ("n", "k"), ("o", "o"), ("p", "p")}
    rows = {r.id: r for r in dedup.store(new, known, "merge")[0].collect()}
    assert sorted(rows) == ["k", "o", "p"] and rows["k"].tags == ["u", "v", "w"] and rows["k"].confidence == 0.9
    with pytest.raises(ValueError, match="copies"):
        dedup.store(new, known, "error")


def test_trouble():
    d = trouble.Detector()
    seen = [d.observe(*x) for x in [("f", '{"a":1,"b":2}', "ValueError"), ("f", '{"b":2,"a":1}', "failed"), ("f", '{"a":1,"b":2}', "fine"), ("g", None, "[]"), ("g", None, " None "), ("g", None, "x", True), ("g", "1", "y")]]
    assert seen == [None, "failures", "repeats", None, "empties", "repeats", None]


def test_models_may_fail_and_may_not_touch_what_they_did_not_see(spark):
    new = spark.createDataFrame([("n1", "fact", "likes tea", [1.0, 0.0]), ("n2", "fact", "boom", [0.0, 1.0]), ("n3", "event", "met", [1.0, 0.1])], "id string, type string, content string, vector array<float>")
    known = spark.createDataFrame([("k1", "fact", "likes coffee", [1.0, 0.0]), ("k2", "fact", "far", [-1.0, 0.0])], new.schema)

    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "no json" if "boom" in t else '```json\n[{"action": "update", "block_id": "k1", "content": "likes tea"}, {"action": "DELETE", "block_id": "unseen"}]\n```')

    found = {(r.id, r.decision, r.target_id) for r in providers.decide(new, known, model, top=1).collect()}
    assert found == {("n1", "UPDATE", "k1"), ("n2", "ADD", None), ("n3", "ADD", None)}

    def broken(texts: pd.Series) -> pd.Series:
        raise RuntimeError("down")

    assert {r.decision for r in providers.decide(new, known, broken).collect()} == {"ADD"}
    read = providers.classify(spark.createDataFrame([("a", None, None, None), ("b", "event", None, 0.3)], "content string, type string, tags array<string>, confidence double"), lambda t: t.map(lambda _: '{"type": "preference", "tags": ["x"], "confidence": 0.8, "escalate": true}'))
    assert [(r.type, r.tags, r.confidence, r.escalate) for r in read.orderBy("content").collect()] == [("preference", ["x"], 0.8, True), ("event", ["x"], 0.3, True)]
    answer = json.dumps([{"type": "entity", "content": "Ann", "confidence": 0.9}, {"content": "Ann has a dog", "confidence": 0.9, "relations": [{"target": "Ann", "relation": "about"}]}, {"content": "weak", "confidence": 0.1}])
    blocks, edges = providers.extract(spark.createDataFrame([(1, "t")], "id int, text string"), lambda t: t.map(lambda _: answer))
    assert sorted(r.content for r in blocks.collect()) == ["Ann", "Ann has a dog"] and [r.relation for r in edges.collect()] == ["about"]
    lessons = providers.learn(spark.createDataFrame([(1, "t")], "id int, text string"), lambda t: t.map(lambda _: json.dumps([{"when": f"w{i}", "do": "d", "verify": None} for i in range(5)] + [{"do": "x"}])))
    assert sorted(r.content for r in lessons.collect()) == [f"When: w{i}\nDo: d" for i in range(3)]


def test_sessions(spark):
    m = spark.createDataFrame([("s", t, q, "user", f"m{t}{q}", f"r{t}{q}", AT) for t in range(4) for q in range(2)] + [("s", 0, 0, "user", "again", "r00", AT)], "session_id string, turn int, seq int, role string, content string, receipt string, at timestamp")
    e = session.episodes(m, spark.createDataFrame([("r31",)], "receipt string")).withColumn("deleted", F.lit(False))
    assert e.count() == 7 and [tuple(r) for r in session.next_turn(e).collect()] == [("s", 4)]
    assert [r.content for r in session.recent_turns(e, 2).orderBy("place").collect()] == ["m20", "m21", "m30"]
    assert [(r.batch, r.text.count(chr(10))) for r in session.buffered(m.where("content <> 'again'"), 3).orderBy("batch").collect()] == [(0, 2), (1, 2)]
    hits = spark.createDataFrame([("q", "a", 1, "fact", "She runs daily", 0.9), ("q", "b", 2, "fact", "Nothing of it", 0.9), ("q", "c", 3, "experience", "running", 0.9), ("q", "d", 4, "fact", "a run", 0.9)], "query_id string, id string, rank int, type string, content string, strength double")
    asked = spark.createDataFrame([("q", "Where does she go running?")], "query_id string, text string")
    assert [r.id for r in session.recall(hits, asked, excluded=spark.createDataFrame([("q", "d")], "query_id string, id string")).collect()] == []
    assert [r.id for r in session.recall(hits, asked.withColumn("text", F.lit("What runs?"))).orderBy("n").collect()] == ["a", "d"]


def test_entities_and_heuristics(spark):
    df = spark.createDataFrame([('Did Ann Lee see "the old mill" with Bob?', "fact")], "t string, k string")
    assert df.select(entities.of_question(F.col("t"))).first()[0] == ["Did Ann Lee", "Ann", "Lee", "Bob", "the old mill"]
    row = spark.createDataFrame([("Olive Garden. We met at Rome, Mike's place.", "entity")], "t string, k string")
    assert row.select(entities.of_record(F.col("t"), F.col("k"))).first()[0] == ["Olive Garden", "Olive", "Garden", "Rome", "Mike"]
    q = spark.createDataFrame([("q", "What did Carla say about 'blue paint'?")], "query_id string, text string")
    c = spark.createDataFrame([("q", "1", 1, "nothing"), ("q", "2", 2, "the blue paint of carla")], "query_id string, id string, rank int, text string")
    assert {r.id: r.score for r in rerank.heuristic(q, c).collect()} == {"1": 1.0, "2": round(0.5 + 0.5 * 3 / 4 + 0.6 + 0.2, 6)}


def test_long_paths_and_contexts(spark):
    edges = spark.createDataFrame([(str(i), f"n{i:02}", f"n{i + 1:02}", "r", 1.0) for i in range(40)], "id string, source_id string, target_id string, relation string, weight double")
    assert len(graph.shortest_path("n00", "n40", edges, Scratch(spark, "t"))) == 41
    facts = spark.createDataFrame([(f"n{i:02}", "fact", f"c{i}" * 30, i / 50) for i in range(41)], "id string, type string, content string, strength double")
    live = graph.undirected(edges).select("a", "b")
    found = context.adaptive(spark.createDataFrame([("q", "n10"), ("q", "n12")], "query_id string, id string"), live, facts)
    assert [(r.id, r.support) for r in found.orderBy("rank").collect()] == [("n11", 2), ("n13", 1), ("n09", 1), ("n12", 0), ("n10", 0)]
    text = context.annotated(found.where("rank = 1"), edges, facts).first()["line"]
    assert text.endswith('| related: r: "' + ("c10" * 30)[:50] + '..."; r: "' + ("c12" * 30)[:50] + '..."')
    whole = context.written(context.within_budget(context.lines(found), 1000), context.confidence_report(found)).first()["context"]
    assert whole.startswith(context.DOUBTFUL) and whole.count("\n") == 5


def test_exact_ranks_of_given_pairs(spark):
    rows = spark.createDataFrame([(f"v{i:02}", [1.0, float(i // 2)]) for i in range(30)], "id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 7.0])], "query_id string, vector array<float>")
    every = {r.id: r["rank"] for r in retrieval.vector_search(q, rows, 30).collect()}
    found = retrieval.vector_ranks(q, rows, rows.selectExpr("'q' as query_id", "id").where("id in ('v03', 'v14', 'v15', 'v29')"))
    assert {r.id: r["rank"] for r in found.collect()} == {i: every[i] for i in ("v03", "v14", "v15", "v29")}


def test_command_line(spark, small, capsys):
    assert cli.run(["--data", small, "stats"], spark).count() > 5
    found = cli.run(["--data", small, "query", "umbrella voucher keys", "--as-of", "2025-09-01", "--limit", "3"], spark).collect()
    assert [r["rank"] for r in found] == [1, 2, 3]
    with tempfile.TemporaryDirectory() as d:
        cli.run(["--data", f"file://{d}/s", "init"], spark)
        assert cli.run(["--data", f"file://{d}/s", "stats"], spark).count() == 3
        cli.run(["--data", small, "export", "--out", f"{d}/out"], spark)
        assert spark.read.json(f"{d}/out").select("id").distinct().count() == spark.read.parquet(f"{small}/blocks.parquet").select("id").distinct().count()
