"""NN-descent and greedy search against brute force."""

import numpy as np

from quillstone.llm import neighbours
from quillstone.plans.scratch import Scratch


def table(spark, n=900):
    rng = np.random.default_rng(7)
    topics = rng.normal(size=(6, 64))
    x = topics[rng.integers(0, 6, n)] + 0.9 * rng.normal(size=(n, 64))
    x[n - 100 :] = x[:100] + 0.05 * rng.normal(size=(100, 64))
    x *= rng.uniform(0.1, 5, size=(n, 1))
    rows = [(f"v{i:04}", [float(a) for a in v], "x") for i, v in enumerate(x)]
    odd = [("null", None, "x"), (None, rows[0][1], "x"), ("short", [1.0], "x"), ("zero", [0.0] * 64, "x"), ("nan", [float("nan")] * 64, "x"), ("hole", [None] + [1.0] * 63, "x"), ("empty", [], "x"), rows[3]]
    return spark.createDataFrame(rows + odd, "block_id string, embedding array<float>, rid string"), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_and_close_pairs(spark):
    df, x = table(spark)
    graph = neighbours.neighbour_graph(df, Scratch(spark, "t"), block=150, dimensions=64)
    found = {}
    for r in neighbours.nearest(graph).collect():
        found.setdefault(int(r.id[1:]), set()).add(int(r.neighbour[1:]))
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    assert len(found) == len(x) and all(len(v) == 5 for v in found.values())
    assert np.mean([len(found[i] & set(best[i])) / 5 for i in range(len(x))]) >= 0.9
    close = [(i, j) for i in range(len(x)) for j in best[i] if s[i, j] >= 0.9]
    assert close and np.mean([j in found[i] for i, j in close]) >= 0.99


def test_greedy_search(spark):
    df, x = table(spark)
    scratch = Scratch(spark, "t")
    graph = neighbours.neighbour_graph(df, scratch, block=150, dimensions=64)
    rng = np.random.default_rng(1)
    q = x[:40] + 0.02 * rng.normal(size=(40, 64))
    queries = spark.createDataFrame([(f"q{i}", [float(a) for a in v]) for i, v in enumerate(q)], "qid string, vector array<float>")
    found = {}
    for r in neighbours.greedy_search(queries, graph, scratch).collect():
        found.setdefault(int(r.qid[1:]), set()).add(int(r.neighbour[1:]))
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(found[i] & set(best[i])) / 5 for i in range(40)]) >= 0.9


def test_few_and_no_vectors(spark):
    df, _ = table(spark)
    few = df.where("block_id in ('v0000', 'v0001', 'zero')")
    graph = neighbours.neighbour_graph(few, Scratch(spark, "t"))
    assert {(r.id, r.neighbour) for r in neighbours.nearest(graph).collect()} == {("v0000", "v0001"), ("v0001", "v0000")}
    graph = neighbours.neighbour_graph(df.limit(0), Scratch(spark, "t"))
    assert neighbours.nearest(graph).count() == 0


def test_copies_fill_a_place_and_other_lengths(spark):
    """A third of all rows is one vector; the length of vectors is taken from the data."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 384))
    x[:200] = x[0]
    rows = [(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(x)] + [("short", [1.0] * 64)]
    df = spark.createDataFrame(rows, "block_id string, embedding array<float>")
    graph = neighbours.neighbour_graph(df, Scratch(spark, "t"), block=20)
    found = neighbours.nearest(graph).collect()
    assert graph.vectors.groupBy("block").count().agg({"count": "max"}).first()[0] < 100
    assert len(found) == 5 * 600
    assert all(r.similarity > 0.9999 and r.neighbour < "v200" for r in found if r.id < "v200")
