"""Hierarchies, orphans and change feeds against brute force on small hand-made tables."""

import json
import random
from datetime import datetime

from quillstone.operators import changefeed, components, hierarchy, orphans
from quillstone.plans import problems
from quillstone.plans.scratch import Scratch

BLOCKS = "id string, parent_id string, children_ids array<string>, extra string, v string"


def brute(rows):
    ids = {r[0] for r in rows if r[0] is not None}
    up = {}
    for i, p, _ in rows:
        if p in ids:
            up[i] = p
    for i in ids - set(up):
        over = [x for x, _, c in rows if x is not None and i in (c or [])]
        if over:
            up[i] = min(over)
    out = {}
    for i in ids:
        path = [i]
        while path[-1] in up and up[path[-1]] not in path:
            path.append(up[path[-1]])
        if path[-1] in up:
            out[i] = (min(path[path.index(up[path[-1]]) :]), None, None)
        else:
            out[i] = (path[-1], len(path) - 1, list(reversed(path)))
    return out


def run(spark, rows):
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(*r, "x", "clash") for r in rows], BLOCKS)
    return hierarchy.paths(hierarchy.hierarchy(hierarchy.resolve_parents(df, scratch), scratch), scratch)


def check(spark, rows):
    found = run(spark, rows).collect()
    want = brute(rows)
    assert {r.v: (r.root, r.depth, r.path) for r in found} == want
    below = {}
    for i, (_, _, path) in want.items():
        for a in path or []:
            below.setdefault(a, set()).add(i)
    trees = [r for r in found if not r.endless]
    for r in trees:
        assert {x.v for x in trees if x.root == r.root and r.pre <= x.pre < r.pre + r.size} == below[r.v]


def test_chain_star_and_cycles(spark):
    chain = [(f"c{i:02}", f"c{i - 1:02}" if i else None, []) for i in range(40)]
    star = [("s", None, [])] + [(f"s{i:03}", "s", None) for i in range(60)]
    loops = [("l1", "l3", []), ("l2", "l1", []), ("l3", "l2", []), ("t1", "l2", []), ("t2", "t1", []), ("self", "self", []), ("under", "self", [])]
    lists = [("p", None, ["k1", "k2", "gone", None]), ("q", "nowhere", ["k1"]), ("k1", None, []), ("k2", "p", []), ("dup", "s", []), ("dup", "s", []), (None, "s", [])]
    check(spark, chain + star + loops + lists)


def test_random_forest(spark):
    rng = random.Random(3)
    rows = [(f"n{i:03}", f"n{rng.randrange(max(1, i)):03}" if i and rng.random() < 0.9 else None, []) for i in range(150)]
    check(spark, rows)


def test_empty_hierarchy_and_descendants(spark):
    assert run(spark, []).count() == 0
    nodes = run(spark, [("a", None, []), ("b", "a", []), ("c", "b", [])])
    assert {(r.v, r.descendant, r.distance) for r in hierarchy.descendants(nodes).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_descendants_of_every_block(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(hierarchy, "CHUNK", 4)
    rows = [(f"n{i:03}", f"n{rng.randrange(max(1, i)):03}" if i and rng.random() < 0.9 else None, []) for i in range(80)]
    rows += [("l1", "l3", []), ("l2", "l1", []), ("l3", "l2", []), ("t1", "l2", []), ("t2", "t1", []), ("t3", "l1", []), ("self", "self", []), ("under", "self", [])]
    want = {(a, r[0]) for r in rows for a in ways_up(rows, r[0])}
    scratch = Scratch(spark, "t")
    nodes = hierarchy.hierarchy(hierarchy.resolve_parents(spark.createDataFrame([(*r, "x", "clash") for r in rows], BLOCKS), scratch), scratch)
    found = [(r.v, r.descendant) for r in hierarchy.descendants(nodes).select("v", "descendant").unionByName(hierarchy.endless_descendants(nodes, scratch)).collect()]
    assert set(found) == want and len(found) == len(want) and {("l1", "l3"), ("l3", "t2"), ("t1", "t2"), ("self", "under")} <= want
    assert "p1_descendants" in problems.QUERIES


def ways_up(rows, i):
    up, out = {r[0]: r[1] for r in rows}, set()
    x = up[i]
    while x is not None and x not in out:
        out.add(x)
        x = up[x]
    return out - {i}


def test_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "z"), (None, "q")] + [(f"m{i:02}", f"m{i + 1:02}") for i in range(30)], "a string, b string")
    found = dict(components.components(edges, Scratch(spark, "t")).collect())
    assert found["c"] == "a" and found["y"] == "x" and found["m30"] == "m00" and "z" not in found and len(found) == 36
    assert components.components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_orphans_wait_resolve_and_reopen(spark):
    t = [datetime(2024, m, 1) for m in range(1, 7)]
    edges = spark.createDataFrame([("e1", "a", "b", t[3]), ("e1", "a", "b", t[3]), ("e2", None, "", t[3]), ("e3", "a", "late", t[0]), ("e4", "a", "dead", None)], "id string, s string, t string, at timestamp")
    refs = orphans.references(edges, "edges", "id", ["s", "t"], "at")
    state = orphans.OrphanState.empty(spark, Scratch(spark, "t")).apply(refs=refs)
    assert state.cases().count() == 6
    parents = spark.createDataFrame([("a", t[0]), ("a", t[2]), ("late", t[5]), ("dead", t[0]), (None, t[0])], "id string, created_at timestamp")
    state = state.apply(parents=parents)
    assert {tuple(r) for r in state.cases().collect()} == {("edges", "e1", "t"), ("edges", "e3", "t")}
    state = state.apply(parents=spark.createDataFrame([("b", t[1])], "id string, created_at timestamp"))
    assert {tuple(r) for r in state.cases().collect()} == {("edges", "e3", "t")}
    state = state.apply(deletions=spark.createDataFrame([("dead",), ("unknown",)], "id string"))
    assert {(r.row_id, r.reason) for r in state.pending.collect()} == {("e3", "early"), ("e4", "deleted")}
    assert {(r.ref_field, r.month, r.reason, r.n_orphans) for r in state.report().collect()} == {("t", "2024-01", "early", 1), ("t", None, "deleted", 1)}
    assert orphans.OrphanState.empty(spark, Scratch(spark, "t")).cases().count() == 0


def test_orphans_in_any_batches(spark):
    t = [datetime(2024, m, 1) for m in range(1, 7)]
    refs = [("edges", "e1", "s", "dead", t[3]), ("edges", "e2", "s", "never", t[3]), ("edges", "e3", "s", "dead", t[0]), ("edges", "e4", "s", "ok", t[3]), ("operations", "o1", "s", "dead", t[3]), ("edges", "e5", "s", "twice", t[2])]
    parents = [("dead", t[1]), ("ok", t[1]), ("twice", t[4]), ("twice", t[1])]
    steps = [("refs", r) for r in refs] + [("parents", p) for p in parents] + [("deletions", ("dead",)), ("deletions", ("never",))]
    want = {("e1", "deleted"), ("e2", "absent"), ("e3", "early")}
    shapes = {"refs": orphans.REF, "parents": "id string, created_at timestamp", "deletions": "id string"}

    def run(*batches):
        state = orphans.OrphanState.empty(spark, Scratch(spark, "t"))
        for batch in batches:
            state = state.apply(**{k: spark.createDataFrame([x for kind, x in steps if kind == k], shapes[k]) for k in batch}, may_dangle=["operations"])
        return state

    # references after the deletion; the deletion before the parent; both
    for batches in (["parents"], ["deletions"], ["refs"]), (["refs"], ["deletions"], ["parents"]), (["deletions"], ["refs", "parents"]), (["deletions", "parents", "refs"],):
        state = run(*batches)
        assert {(r.row_id, r.reason) for r in state.pending.collect()} == want, batches
        assert {r.row_id for r in state.settled.collect()} == {"e4", "e5", "o1"}, batches
    # a parent that comes again, with an earlier time
    state = orphans.OrphanState.empty(spark, Scratch(spark, "t")).apply(refs=spark.createDataFrame(refs[-1:], orphans.REF), parents=spark.createDataFrame(parents[2:3], shapes["parents"]))
    assert state.cases().count() == 1 and state.apply(parents=spark.createDataFrame(parents[3:], shapes["parents"])).cases().count() == 0


OPS = "id string, block_id string, clock bigint, timestamp timestamp, action string, data string, extra string"


def fold(rows):
    alive = {}
    for i, block, clock, at, action, data, *_ in sorted((r for r in set(rows) if r[1] and r[2] is not None), key=lambda r: (r[1], r[2], r[3] or datetime(1, 1, 1), r[0] or "")):
        action = (action or "").strip().lower()
        value = changefeed.as_object(data)
        if action == "delete":
            alive.pop(block, None)
        elif action == "create" and value is not None:
            alive[block] = (clock, value)
        elif action == "update" and value is not None and block in alive:
            alive[block] = (clock, {**alive[block][1], **value})
    return alive


def test_replay_of_a_hot_block(spark):
    rng, rows = random.Random(5), []
    for i in range(3000):
        block = "hot" if rng.random() < 0.4 else f"b{rng.randrange(60)}"
        data = rng.choice(['{"a": 1}', '{"b": %d}' % i, '{"c": ', "[1]", None, ""])
        rows.append((f"o{i}", rng.choice([block, block, block, None, ""]), rng.choice([None, rng.randrange(800), rng.randrange(800)]), rng.choice([None, datetime(2024, 1, 1 + i % 20)]), rng.choice(["create", " Update", "UPDATE ", "update", "delete", "link", None]), data, "x"))
    rows += rows[:200]
    feed = spark.createDataFrame(rows, OPS)
    found = {r.block_id: (r.clock, json.loads(r.data)) for r in changefeed.replay(feed).collect()}
    assert found == fold(rows) and "hot" in {r[1] for r in rows}
    assert changefeed.replay(feed.limit(0)).count() == 0


def test_patches_compose_in_any_grouping():
    rng = random.Random(1)
    ops = [changefeed.operation(rng.choice(["create", "update", "delete"]), json.dumps({rng.choice("abc"): i}), i) for i in range(12)]
    for _ in range(50):
        parts = list(ops)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [changefeed.then(parts[k], parts[k + 1])]
        left = ops[0]
        for o in ops[1:]:
            left = changefeed.then(left, o)
        assert parts[0] == left


def test_base_comes_before_the_feed(spark):
    base = spark.createDataFrame([("a", 900, '{"x": 1}'), ("b", 1, '{"y": 1}')], "block_id string, clock bigint, data string")
    feed = spark.createDataFrame([("1", "a", 5, None, "update", '{"z": 2}', ""), ("2", "b", 6, None, "delete", None, "")], OPS)
    assert [(r.block_id, r.clock, json.loads(r.data)) for r in changefeed.replay(feed, base).collect()] == [("a", 5, {"x": 1, "z": 2})]
