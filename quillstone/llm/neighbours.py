"""The most similar vectors of every vector, by NN-descent on blocks.

1. Vectors are normalised and kept as 16-bit numbers with a scale (cosines are right to about 0.00001). Centroids of about
   ``SAMPLE`` vectors, taken by the hash of the id, give cells; a cell of more than ``BLOCK`` vectors is cut by the sides of
   fixed random planes, and a place that still holds more than ``HOT`` blocks' worth (copies) by hash. Every vector has its home block.
2. The first graph: in its home block, and in the blocks of its next nearest cells up to ``PLACES``, a vector meets all members.
3. NN-descent: the graph is joined with itself. A path from a vector over a neighbour to a neighbour's neighbour,
   or between two neighbours of one vector, is followed if one of its edges is fresh, new since the last round. The
   vector visits the home block of that candidate, unless it has been there, and meets the candidate with the whole block as a matrix product.
   Both sides keep their ``KEPT`` best. Rounds end when fewer than ``SETTLED`` of the neighbours are fresh, or after ``ROUNDS``.

Only fresh edges are expanded, a vector travels once to each block it visits, and blocks answer with improvements alone.
A row number holds its block, so that the joins need no look-up of homes. What reaches the driver is the sample and one number a round.

Recall against brute force is measured by the tests and in the README. Queries with other vectors use ``greedy_search`` over
the graph. Defined results: null ids, null vectors and vectors that are not ``dimensions`` finite numbers, not all zero, are
left out (``dimensions`` not given: the most frequent length); an id in several rows is one vector (the smallest bytes); fewer vectors
than asked for give fewer neighbours; ties go to any; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.plans.scratch import Scratch

#: Neighbours kept; vectors of a block; cells that a vector meets first; a place of more than so many blocks' worth is cut by hash.
KEPT, BLOCK, PLACES, HOT = 8, 1024, 3, 4
#: Vectors of the fitted sample; cells; planes that cut a cell; rounds; share of fresh neighbours that ends them.
SAMPLE, MOST_CELLS, PLANES, ROUNDS, SETTLED = 32_768, 4096, 16, 6, 0.03
#: Bits of a row number: member of a block, part of a place.
MEMBER_BITS, PART_BITS = 21, 14
#: Vectors of one task.
TASK_VECTORS = 8192


def _bytes(whole: np.ndarray) -> pa.Array:
    """A binary column from a matrix of bytes, one row each."""
    n, width = whole.shape
    ends = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(whole))])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a binary column, all of one length, as a matrix of bytes."""
    parts = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    out = []
    for c in parts:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(c), -1))
    return np.concatenate(out) if len(out) != 1 else out[0]


def packed(x: np.ndarray) -> np.ndarray:
    """Rows as bytes: a scale, then 16-bit numbers of the row brought to length 1."""
    peak = np.abs(x).max(axis=1, keepdims=True)
    x = (x / peak).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = (np.abs(x).max(axis=1, keepdims=True) / 32767).astype(np.float32)
    return np.concatenate((scale.view(np.uint8), np.rint(x / scale).astype(np.int16).view(np.uint8)), axis=1)


def unpacked(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data[:, 4:]).view(np.int16).astype(np.float32) * np.ascontiguousarray(data[:, :4]).view(np.float32)


def _pack(dimensions: int) -> Callable:
    """Usable rows of ``id, vector`` as ``id, q``; of equal ids in a batch one row is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vectors = b.column(0), b.column(1)
            fits = np.asarray(vectors.value_lengths().fill_null(-1)) == dimensions
            fits &= ~np.asarray(ids.is_null())
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            flat = vectors.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan"))
            x = np.asarray(flat).reshape(len(at), dimensions)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            at, q = at[good], packed(x[good]) if good.any() else np.zeros((0, 1), np.uint8)
            first: dict[str, int] = {}
            for i, name in enumerate(ids.take(pa.array(at)).to_pylist()):
                if name not in first or q[i].tobytes() < q[first[name]].tobytes():
                    first[name] = i
            if first:
                yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), _bytes(q[list(first.values())])], names=["id", "q"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every id; rows come sorted by id."""
    last = None
    for b in batches:
        ids = b.column(0).to_pylist()
        keep = [x != y for x, y in zip(ids, [last, *ids[:-1]], strict=True)]
        last = ids[-1] if ids else last
        yield b.filter(pa.array(keep, pa.bool_()))


def vectors_of(rows: DataFrame, dimensions: int | None, id_col: str = "block_id", vector_col: str = "embedding") -> DataFrame:
    """``id, q``: every id with a usable vector, once."""
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    if dimensions is None:
        sizes = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).count()
        found = sizes.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
        dimensions = found or 1
    some = rows.where("id is not null and vector is not null").mapInArrow(_pack(dimensions), "id string, q binary")
    return some.repartition("id").sortWithinPartitions("id", "q").mapInArrow(_once, "id string, q binary")


@dataclass
class Cells:
    """The fitted index: centroids, planes, and how many planes cut each cell."""

    centre: np.ndarray
    plane: np.ndarray
    mask: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, n: int, block: int) -> Cells:
        """Spherical k-means on the sample; at most ``MOST_CELLS`` centroids."""
        k = min(max(1, -(-n // block)), MOST_CELLS, len(sample))
        c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
        for _ in range(8):
            near = np.concatenate([(sample[s : s + 4096] @ c.T).argmax(axis=1) for s in range(0, len(sample), 4096)])
            total = np.zeros_like(c)
            np.add.at(total, near, sample)
            size = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(size > 0, total / np.maximum(size, 1e-9), c).astype(np.float32)
        held = np.bincount(near, minlength=k) * (n / len(sample))
        bits = np.clip(np.ceil(np.log2(np.maximum(held, 1) / (2 * block))), 0, PLANES).astype(np.int64)
        plane = np.random.default_rng(42).normal(size=(sample.shape[1], PLANES)).astype(np.float32)
        return cls(c, plane, (np.int64(1) << bits) - 1)

    def places(self, x: np.ndarray, most: int) -> np.ndarray:
        """The places of the nearest cells of each row, nearest first."""
        most = min(most, len(self.centre))
        s = x @ self.centre.T
        near = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(self.centre) else np.tile(np.arange(most), (len(x), 1))
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        side = ((x[:, None, :] - self.centre[near]) @ self.plane > 0) @ (np.int64(1) << np.arange(PLANES)) if self.mask.any() else np.zeros(near.shape, np.int64)
        return (near.astype(np.int64) << PLANES) | (side & self.mask[near])


def _place(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                p = shared.value.places(unpacked(_matrix(b.column(1))), PLACES)
                ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=["id", "q", "places"])

    return run


def _hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few true cells of a matrix."""
    flat = mask.ravel()
    wide = flat[: len(flat) // 8 * 8].view(np.uint64)
    at = np.flatnonzero(wide)
    at = (at[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate((at[flat[at]], np.flatnonzero(flat[len(wide) * 8 :]) + len(wide) * 8))
    return np.divmod(at, mask.shape[1])


def best(row: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``KEPT`` best different neighbours of every row, sorted by row, best first."""
    o = np.lexsort((-sim, nbr, row))
    row, nbr, sim = row[o], nbr[o], sim[o]
    first = np.concatenate(([True], (row[1:] != row[:-1]) | (nbr[1:] != nbr[:-1])))[: len(row)]
    row, nbr, sim = row[first], nbr[first], sim[first]
    o = np.lexsort((nbr, -sim, row))
    row, nbr, sim = row[o], nbr[o], sim[o]
    start = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))[: len(row)])
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row)))) < KEPT
    return row[keep], nbr[keep], sim[keep]


#: A neighbour in a list: its row number and the similarity.
ENTRY = np.dtype([("nbr", "<i8"), ("sim", "<f4")])


def _lists(row: np.ndarray, nbr: np.ndarray, sim: np.ndarray, n: int) -> pa.Array:
    """Binary lists of entries for rows 0 to n - 1; ``row`` is sorted."""
    whole = np.empty(len(row), ENTRY)
    whole["nbr"], whole["sim"] = nbr, sim
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32) * ENTRY.itemsize
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(whole)])


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and similarity of all entries of a column of lists."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, ENTRY, (ends[-1] - ends[0]) // ENTRY.itemsize, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, ENTRY)
    return np.repeat(np.arange(len(column)), np.diff(ends) // ENTRY.itemsize), whole["nbr"], whole["sim"]


def _least(row: np.ndarray, sim: np.ndarray, n: int) -> np.ndarray:
    """What a new neighbour of each row must exceed; ``row`` is sorted, best first."""
    held = np.bincount(row, minlength=n)
    out = np.full(n, -2, np.float32)
    full = held == KEPT
    out[full] = sim[np.cumsum(held)[full] - 1]
    return out


def _meet(x: np.ndarray, y: np.ndarray, x_least: np.ndarray, y_least: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``x`` and ``y`` that either side may want, with their similarities. ``same``: ``x`` and ``y`` are one."""
    found = []
    for s in range(0, len(x), 512):
        t = x[s : s + 512] @ y.T
        if same:
            t[np.arange(len(t)), s + np.arange(len(t))] = -3
        if t.shape[1] > KEPT and (bare := x_least[s : s + 512] == -2).any():
            some = t[bare]
            j = np.argpartition(-some, KEPT - 1, axis=1)[:, :KEPT]
            found.append((np.repeat(s + np.flatnonzero(bare), KEPT), j.ravel(), np.take_along_axis(some, j, 1).ravel()))
            mask = t > np.where(bare, np.float32(2), x_least[s : s + 512])[:, None]
        else:
            mask = t > x_least[s : s + 512, None]
        if not same:
            mask |= t > y_least
        i, j = _hits(mask)
        found.append((s + i, j, t[i, j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each block and compares them with each other. Rows come sorted by block."""
    for block, t in _groups(batches, "block"):
        data = _matrix(t.column("q"))
        n, x = len(data), unpacked(data)
        least = np.full(n, -2, np.float32)
        row, nbr, sim = best(*_meet(x, x, least, least, True)) if n > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        real = sim > -3
        row, nbr, sim = row[real], nbr[real], sim[real]
        rid = (np.int64(block) << MEMBER_BITS) + np.arange(n)
        columns = [pa.array(rid), t.column("id").combine_chunks(), _bytes(data), t.column("others").combine_chunks()]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(_least(row, sim, n)), _lists(row, rid[nbr], sim, n)], names=["rid", "id", "q", "others", "least", "list"])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows with one key, one key after the other."""
    held: list[pa.RecordBatch] = []
    current = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.asarray(b.column(b.schema.get_field_index(key)))
        edge = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if k[a] != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = k[a]
            held.append(b.slice(a, z - a))
    if held:
        yield current, pa.Table.from_batches(held)


ANSWER = "rid bigint, home bigint, met bigint, list binary"


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's members (kind 0) and its visitors (kind 1), sorted by block and kind: what either side gains.

    Visitors are met a batch at a time. A visitor always gets an answer, empty if it gains nothing, that says where it has been.
    """
    current, rid, x, least, own, ready = None, [], [], [], [], False

    def answer() -> Iterator[pa.RecordBatch]:
        if own:
            row, nbr, sim = best(*(np.concatenate(c) for c in zip(*own, strict=True)))
            u = np.unique(row)
            yield pa.RecordBatch.from_arrays([pa.array(rid[u]), pa.array(np.full(len(u), current)), pa.nulls(len(u), pa.int64()), _lists(np.searchsorted(u, row), nbr, sim, len(u))], names=["rid", "home", "met", "list"])

    for b in batches:
        if not b.num_rows:
            continue
        block, kind, rids, leasts = (np.asarray(b.column(i)) for i in (0, 1, 2, 4))
        data = unpacked(_matrix(b.column(3)))
        change = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        edge = [0, *change.tolist(), len(block)]
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if block[a] != current:
                if ready:
                    yield from answer()
                current, rid, x, least, own, ready = block[a], [], [], [], [], False
            if kind[a] == 0:
                rid.append(rids[a:z])
                x.append(data[a:z])
                least.append(leasts[a:z])
                continue
            if not ready:
                ready = True
                rid, x, least = (np.concatenate(c) if c else np.zeros((0, data.shape[1]) if c is x else 0, np.float32) for c in (rid, x, least))
            if not len(rid):
                continue
            i, j, sim = _meet(data[a:z], x, leasts[a:z], least, False)
            gain = sim > least[j]
            own.append((j[gain], rids[a:z][i[gain]], sim[gain]))
            if sum(len(c[0]) for c in own) > 4 * KEPT * len(rid):
                own = [best(*(np.concatenate(c) for c in zip(*own, strict=True)))]
            gain = sim > leasts[a:z][i]
            row, nbr, sim = best(i[gain], rid[j[gain]], sim[gain])
            n = z - a
            yield pa.RecordBatch.from_arrays([pa.array(rids[a:z]), pa.array(rids[a:z] >> MEMBER_BITS), pa.array(np.full(n, current)), _lists(row, nbr, sim, n)], names=["rid", "home", "met", "list"])
    if ready:
        yield from answer()


GRAPH = "rid bigint, nbr array<bigint>, sim array<float>, fresh array<boolean>, met array<bigint>, least float, list binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector from its list so far (kind 0) and the answers to it (kind 1). Rows come sorted by home block."""
    for _, t in _groups(batches, "home"):
        rid, kind = np.asarray(t.column("rid")), np.asarray(t.column("kind"))
        u = np.unique(rid[kind == 0])
        at = np.searchsorted(u, rid)
        row, nbr, sim = _entries(t.column("list").combine_chunks())
        new = kind[row] == 1
        before = np.stack((at[row[~new]], nbr[~new]), axis=1)
        row, nbr, sim = best(at[row], nbr, sim)
        n = len(u)
        known = set(map(tuple, before.tolist()))
        fresh = np.fromiter(((r, w) not in known for r, w in zip(row.tolist(), nbr.tolist(), strict=True)), bool, len(row)) if new.any() else np.zeros(len(row), bool)
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32))
        lists = lambda values: pa.ListArray.from_arrays(ends, pa.array(values))
        been_row, been = [], []
        old = t.column("been").combine_chunks()
        lengths = np.asarray(old.value_lengths().fill_null(0))
        been_row.append(np.repeat(at, lengths))
        been.append(np.asarray(old.flatten()))
        met = t.column("met").combine_chunks()
        some = ~np.asarray(met.is_null())
        been_row.append(at[some])
        been.append(np.asarray(met.drop_null()))
        pairs = np.unique(np.stack((np.concatenate(been_row).astype(np.int64), np.concatenate(been).astype(np.int64)), axis=1), axis=0)
        met_ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=n)))).astype(np.int32))
        columns = [pa.array(u), lists(nbr), lists(sim), lists(fresh), pa.ListArray.from_arrays(met_ends, pa.array(pairs[:, 1])), pa.array(_least(row, sim, n)), _lists(row, nbr, sim, n)]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "nbr", "sim", "fresh", "met", "least", "list"])


def _home(rid: Column) -> Column:
    return F.shiftright(rid, MEMBER_BITS)


def _answers(own: DataFrame, visits: DataFrame, tasks: int, scratch: Scratch) -> DataFrame:
    """Answers to visits; both have ``block, rid, q, least``."""
    columns = ["rid", "q", "least"]
    both = own.select("block", F.lit(0).alias("kind"), *columns).unionByName(visits.select("block", F.lit(1).alias("kind"), *columns))
    return scratch.cut(both.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_visits, ANSWER), "answers")


def _merged(lists: DataFrame, answers: DataFrame, tasks: int, scratch: Scratch) -> DataFrame:
    """Lists ``rid, list, been`` with what the answers add."""
    old = lists.select("rid", _home(F.col("rid")).alias("home"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("met"), "list", "been")
    new = answers.select("rid", "home", F.lit(1).alias("kind"), "met", "list", F.array().cast("array<bigint>").alias("been"))
    return scratch.cut(old.unionByName(new).repartition(tasks, "home").sortWithinPartitions("home").mapInArrow(_merge, GRAPH), "graph")


@dataclass
class Graph:
    """``vectors``: rid, id, q, block; ``edges``: rid, nbr, sim (best first); the fitted cells, None without vectors."""

    vectors: DataFrame
    edges: DataFrame
    cells: Cells | None


def _blocks(placed: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """``block, id, q, others``: home block and the blocks of the next cells; places that hold too many are cut by hash."""
    hot = scratch.cut(placed.groupBy(F.col("places")[0].alias("place")).count().where(F.col("count") > HOT * block), "hot")
    number = lambda place, part: F.shiftleft(place, PART_BITS) + part
    if hot.isEmpty():
        blocks = F.transform("places", lambda p: number(p, F.lit(0).cast("long")))
    else:
        parts = hot.select("place", F.least(F.ceil(F.col("count") / block), F.lit(1 << PART_BITS)).alias("k"))
        each = placed.select("id", F.posexplode("places").alias("n", "place")).join(parts, "place", "left")
        part = F.coalesce(F.pmod(F.xxhash64("id", "n"), F.col("k")), F.lit(0)).cast("long")
        each = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", number(F.col("place"), part).alias("b")))).alias("x"))
        placed, blocks = placed.join(each, "id"), F.transform("x", lambda x: x["b"])
    return placed.select(blocks.alias("blocks"), "id", "q").select(F.col("blocks")[0].alias("block"), "id", "q", F.expr("slice(blocks, 2, 9)").alias("others"))


def neighbour_graph(rows: DataFrame, scratch: Scratch, block: int = BLOCK, dimensions: int | None = None, id_col: str = "block_id", vector_col: str = "embedding") -> Graph:
    """The vectors and, for each, its ``KEPT`` best neighbours found."""
    spark = rows.sparkSession
    every = scratch.cut(vectors_of(rows, dimensions, id_col, vector_col), "every")
    n = every.count()
    if not n:
        return Graph(spark.createDataFrame([], "rid bigint, id string, q binary, block bigint"), spark.createDataFrame([], "rid bigint, nbr array<bigint>, sim array<float>"), None)
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1 << 30, (SAMPLE << 30) // n + 1)
    sample = np.stack([np.frombuffer(r[0], np.uint8) for r in every.where(share).select("q").collect()] or [np.frombuffer(every.head()["q"], np.uint8)])
    cells = Cells.fit(unpacked(sample), n, block)
    placed = scratch.cut(every.mapInArrow(_place(spark.sparkContext.broadcast(cells)), "id string, q binary, places array<bigint>"), "placed")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_VECTORS))
    homes = _blocks(placed, scratch, block).repartition(tasks, "block").sortWithinPartitions("block", "id")
    members = scratch.cut(homes.mapInArrow(_members, "rid bigint, id string, q binary, others array<bigint>, least float, list binary"), "members")
    scratch.drop(every, placed)

    home = _home(F.col("rid")).alias("block")
    answers = _answers(members.select(home, "rid", "q", "least"), members.select(F.explode("others").alias("block"), "rid", "q", "least"), tasks, scratch)
    graph = _merged(members.select("rid", "list", F.array(home).alias("been")), answers, tasks, scratch)
    scratch.drop(answers)
    everything = True  # in the first round every edge is fresh
    for _ in range(ROUNDS):
        fresh = F.transform("fresh", lambda x: F.lit(True)) if everything else F.col("fresh")
        paths = graph.select("rid", "nbr", fresh.alias("fresh"))
        homes_of = F.array_distinct(F.transform("nbr", _home))
        fresh_homes = F.array_distinct(F.transform(F.filter(F.arrays_zip("nbr", "fresh"), lambda e: e["fresh"]), lambda e: _home(e["nbr"])))
        around = paths.select("rid", homes_of.alias("homes"), fresh_homes.alias("fresh_homes"))
        edges = paths.select(F.col("rid").alias("v"), F.explode(F.arrays_zip("nbr", "fresh")).alias("e")).select("v", F.col("e.nbr").alias("w"), F.col("e.fresh").alias("f"))
        open_ = F.when(F.col("f"), F.col("homes")).otherwise(F.col("fresh_homes"))
        over = edges.join(around, F.col("w") == F.col("rid")).select("v", F.explode(open_).alias("block"))
        beside = paths.select("nbr", "fresh", homes_of.alias("homes"), fresh_homes.alias("fresh_homes")).select(F.explode(F.arrays_zip("nbr", "fresh")).alias("e"), "homes", "fresh_homes")
        beside = beside.select(F.col("e.nbr").alias("v"), F.col("e.fresh").alias("f"), "homes", "fresh_homes").select("v", F.explode(open_).alias("block"))
        wanted = over.unionByName(beside).where(F.col("block") != _home(F.col("v"))).distinct()
        known = members.select("rid", "q").join(graph.select("rid", "met", "least"), "rid")
        visits = wanted.join(known, F.col("v") == F.col("rid")).where(~F.array_contains("met", F.col("block"))).select("block", "rid", "q", "least")
        own = members.select("rid", "q").join(graph.select("rid", "least"), "rid")  # its exchange of members is that of ``known``
        answers = _answers(own.select(home, "rid", "q", "least"), visits, tasks, scratch)
        better = _merged(graph.select("rid", "list", F.col("met").alias("been")), answers, tasks, scratch)
        scratch.drop(answers, graph)
        graph, everything = better, False
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))) / F.sum(F.size("nbr"))).first()[0] or 0
        if changed < SETTLED:
            break
    return Graph(members.select("rid", "id", "q", home), graph.select("rid", "nbr", "sim"), cells)


def nearest(graph: Graph, k: int = 5, least: float | None = None) -> DataFrame:
    """``id, rank, neighbour, similarity`` of the ``k`` best, best first; ``least`` leaves out less similar ones."""
    top = graph.edges.select("rid", F.posexplode(F.slice(F.arrays_zip("nbr", "sim"), 1, k)).alias("rank", "x"))
    if least is not None:
        top = top.where(F.col("x.sim") >= least)
    top = top.select("rid", (F.col("rank") + 1).alias("rank"), F.col("x.nbr").alias("w"), F.col("x.sim").alias("similarity"))
    names = graph.vectors.select("rid", "id")
    return top.join(names, "rid").join(names.select(F.col("rid").alias("w"), F.col("id").alias("neighbour")), "w").select("id", "rank", "neighbour", "similarity")


def greedy_search(queries: DataFrame, graph: Graph, scratch: Scratch, k: int = 5, entries: int = 8) -> DataFrame:
    """``qid, neighbour, similarity`` for other vectors ``qid, vector``, by greedy search over the graph; ``k`` is at most ``KEPT``.

    A query enters at the blocks of its ``entries`` nearest cells and keeps its ``KEPT`` best. Every step goes to the graph neighbours of
    what is new among them and meets these with their blocks, each block once; the search ends when no step leads to another block.
    """
    if k > KEPT:
        raise ValueError(f"k is at most {KEPT}")
    spark = queries.sparkSession
    if graph.cells is None:
        return spark.createDataFrame([], "qid string, neighbour string, similarity float")
    shared = spark.sparkContext.broadcast(graph.cells)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = shared.value.places(unpacked(_matrix(b.column(1))), entries)
                ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=["id", "q", "places"])

    found = scratch.cut(vectors_of(queries, graph.cells.centre.shape[1], "qid", "vector").mapInArrow(enter, "id string, q binary, places array<bigint>"), "found")
    n = found.count()
    group = F.pmod(F.xxhash64("id"), F.lit(max(1, n // TASK_VECTORS)))
    number = F.row_number().over(Window.partitionBy("g").orderBy("id")).cast("long")
    q = scratch.cut(found.withColumn("g", group).withColumn("rid", F.shiftleft(F.col("g"), MEMBER_BITS) + number - 1).drop("g"), "queries")
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // TASK_VECTORS))
    blocks = graph.vectors.select("block").distinct().withColumn("place", F.shiftright("block", PART_BITS))
    visits = q.select("rid", "q", F.explode("places").alias("place")).join(blocks, "place").select("block", "rid", "q", F.lit(-2.0).cast("float").alias("least"))
    state = q.select("rid", F.lit(b"").alias("list"), F.array().cast("array<bigint>").alias("met"))
    while True:
        visits = scratch.cut(visits, "visits")
        if visits.isEmpty():
            break
        own = graph.vectors.join(visits.select("block").distinct(), "block", "left_semi").withColumn("least", F.lit(2.0).cast("float"))
        state = _merged(state.select("rid", "list", F.col("met").alias("been")), _answers(own, visits, tasks, scratch), tasks, scratch)
        new = state.select("rid", F.explode(F.filter(F.arrays_zip("nbr", "fresh"), lambda e: e["fresh"])).alias("e")).select(F.col("rid").alias("v"), F.col("e.nbr").alias("w"))
        steps = new.join(graph.edges.select(F.col("rid").alias("w"), F.explode("nbr").alias("u")), "w").select("v", _home(F.col("u")).alias("block")).distinct()
        known = q.select("rid", "q").join(state.select("rid", "met", "least"), "rid")
        visits = steps.join(known, F.col("v") == F.col("rid")).where(~F.array_contains("met", F.col("block"))).select("block", "rid", "q", "least")
    if "nbr" not in state.columns:
        return spark.createDataFrame([], "qid string, neighbour string, similarity float")
    top = state.select("rid", F.explode(F.slice(F.arrays_zip("nbr", "sim"), 1, k)).alias("x")).join(q.select("rid", F.col("id").alias("qid")), "rid")
    return top.select("qid", F.col("x.nbr").alias("w"), F.col("x.sim").alias("similarity")).join(graph.vectors.select(F.col("rid").alias("w"), F.col("id").alias("neighbour")), "w").select("qid", "neighbour", "similarity")
