"""Parent-child rows to full hierarchies by heavy-path decomposition.

Steps, each a handful of joins on written tables, with rounds in the logarithm of the depth:

1. ``resolve_parents``: one parent per id.
2. Subtree sizes by doubling: a node's count over distances below ``2^k`` plus the counts of the nodes
   exactly ``2^k`` below it gives distances below ``2^(k+1)``. A node leaves once it has no ``2^k``-th
   ancestor. In a finite tree that set shrinks every round, so a round without change leaves just the
   nodes whose way up never ends; they are set apart.
3. Each parent's heaviest child continues its chain; chain heads and positions by pointer jumping.
4. Chains form a tree at most ``log2(n)`` deep; jumping over chains adds up depths and preorder starts.
   Visiting the heavy child first makes every chain an interval, and every subtree the interval
   ``[pre, pre + size)`` within its root.
5. ``paths`` concatenates chain segments; ``descendants`` reads them from the intervals.

Defined results: null ids are no nodes; an id in several rows is one node (greatest parent, then list);
null, empty or unknown parents count as none; a null list is empty; among several listing blocks the
smallest id wins; a node that is its own parent is a cycle of one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.plans.scratch import Scratch

#: Siblings of one parent are numbered in this many buckets, so that no task sorts all of a hot parent's children.
SIBLING_BUCKETS = 512
#: Preorder positions in one list of descendants.
CHUNK = 256


def resolve_parents(blocks: DataFrame, scratch: Scratch, id_col: str = "id", parent_col: str = "parent_id", children_col: str = "children_ids") -> DataFrame:
    """``v, up``: every id once with its parent, null for tops.

    The parent is the row named by ``parent_col``; where that is null or unknown, the row that lists the id.
    """
    one = blocks.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("v")).agg(F.max(F.struct(F.col(parent_col).alias("p"), F.col(children_col).alias("c"))).alias("s"))
    one = scratch.cut(one.select("v", "s.p", "s.c"), "nodes")
    known = one.select(F.col("v").alias("known"))
    own = one.select("v", "p").join(known, F.col("p") == F.col("known"), "left").select("v", "known")
    listed = one.select(F.col("v").alias("lister"), F.explode("c").alias("child")).where("child is not null").groupBy("child").agg(F.min("lister").alias("lister"))
    out = own.join(listed, F.col("v") == F.col("child"), "left").select("v", F.coalesce("known", "lister").alias("up"))
    return scratch.cut(out, "parents")


def _sizes(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Subtree sizes ``v, size`` (meaningless for endless nodes), and the endless nodes ``v, up``."""
    active = scratch.cut(links.where("up is not null").select("v", F.col("up").alias("p"), F.lit(1).cast("long").alias("size")), "active")
    left, parts = active.count(), []
    while left:
        part = scratch.cut(active.groupBy(F.col("p").alias("v")).agg(F.sum("size").alias("more")), "sizes")
        parts.append(part)
        up = active.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = scratch.cut(active.join(up, "p").select("v", F.col("pp").alias("p"), "size").join(part, "v", "left").select("v", "p", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "active")
        scratch.drop(active)
        active, before, left = jumped, left, jumped.count()
        if left == before:
            break
    size = links.select("v", F.lit(1).cast("long").alias("more"))
    for part in parts:
        size = size.unionByName(part)
    endless = links.join(active.select("v"), "v", "left_semi") if left else links.limit(0)
    return size.groupBy("v").agg(F.sum("more").alias("size")), endless


def _cycle_windows(endless: DataFrame, scratch: Scratch) -> DataFrame:
    """``v, p, m2`` of endless nodes ``v, up``: ``p`` takes every node of a cycle and nothing else, ``m2`` is the smallest id on the cycle.

    Doubling keeps the smallest id of the ``2^k`` steps from ``v``. Once the jump targets no longer get
    fewer they are the cycles; once neighbouring windows on them share their minimum they cover the cycle.
    """
    now = scratch.cut(endless.select("v", F.col("up").alias("p"), F.col("v").alias("m")), "cycle")
    if now.isEmpty():
        return now.select("v", "p", F.col("m").alias("m2"))
    while True:
        ahead = now.select(F.col("v").alias("p"), F.col("p").alias("q"), F.col("m").alias("m2"))
        both = scratch.cut(now.join(ahead, "p"), "cycle")
        here, there = both.agg(F.count_distinct("p"), F.count_distinct("q")).first()
        if here == there and both.where("m <> m2").join(both.select(F.col("p").alias("v")).distinct(), "v", "left_semi").isEmpty():
            return both
        scratch.drop(now)
        now = both.select("v", F.col("q").alias("p"), F.least("m", "m2").alias("m"))


def _cycle_roots(endless: DataFrame, scratch: Scratch) -> DataFrame:
    """``v, root``: the smallest id on the cycle that each endless node runs into."""
    return _cycle_windows(endless, scratch).select("v", F.col("m2").alias("root"))


def _climb(links: DataFrame, scratch: Scratch, sums: list[str]) -> DataFrame:
    """From ``v, up, sums`` with null ``up`` at the tops: ``v, top`` and the sums over all steps up."""
    done = [links.where("up is null").select("v", F.col("v").alias("top"), *[F.lit(0).cast("long").alias(s) for s in sums])]
    active = scratch.cut(links.where("up is not null").select("v", F.col("up").alias("top"), *sums), "climb")
    while not active.isEmpty():
        ended = done[0]
        for d in done[1:]:
            ended = ended.unionByName(d)
        known = ended.withColumn("ended", F.lit(True)).unionByName(active.withColumn("ended", F.lit(False)))
        known = known.select(F.col("v").alias("k"), F.col("top").alias("next"), "ended", *[F.col(s).alias(f"{s}_k") for s in sums])
        step = scratch.cut(active.join(known, F.col("top") == F.col("k")).select("v", F.col("next").alias("top"), "ended", *[(F.col(s) + F.col(f"{s}_k")).alias(s) for s in sums]), "climb")
        done.append(step.where("ended").drop("ended"))
        active = step.where("not ended").drop("ended")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def hierarchy(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """From ``v, up`` (unique ``v``): ``v, up, root, depth, chain, pos, size, pre, endless``.

    ``size`` counts a node and its descendants, which are the nodes of the same root with ``pre`` in
    ``[pre, pre + size)``. Where the way up never ends, ``root`` is the smallest id on the cycle and the
    other figures are null.
    """
    size, endless = _sizes(parents, scratch)
    endless = scratch.cut(endless, "endless")
    trees = parents if endless.isEmpty() else parents.join(endless.select("v"), "v", "left_anti")
    trees = scratch.cut(trees.join(size, "v"), "trees")
    heavy = scratch.cut(trees.where("up is not null").groupBy(F.col("up").alias("u")).agg(F.max(F.struct("size", F.col("v").alias("hv"))).alias("h")).select("u", "h.hv", F.col("h.size").alias("heavy_size")), "heavy")
    marked = scratch.cut(trees.join(heavy.select(F.col("hv").alias("v"), F.lit(True).alias("heavy")), "v", "left").select("v", "up", "size", F.coalesce("heavy", F.lit(False)).alias("heavy")), "marked")
    chains = _climb(marked.select("v", F.when(F.col("heavy"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("pos")), scratch, ["pos"])
    chains = scratch.cut(chains.select("v", F.col("top").alias("chain"), "pos"), "chains")
    # chain heads below another chain, with the preorder offset of their subtree among their siblings
    light = marked.where("up is not null and not heavy").select("v", "up", "size", F.pmod(F.xxhash64("v"), F.lit(SIBLING_BUCKETS)).alias("b"))
    before = Window.partitionBy("up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = light.groupBy("up", "b").agg(F.sum("size").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("up", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("o", F.coalesce(F.sum("size").over(within), F.lit(0))).join(buckets, ["up", "b"]).select("v", "up", (F.col("o") + F.col("n")).alias("o"))
    at = heavy.select("u", "heavy_size").join(chains.select(F.col("v").alias("u"), F.col("chain").alias("over"), F.col("pos").alias("at")), "u")
    light = light.join(at, F.col("up") == F.col("u")).select("v", F.col("over").alias("up"), (F.col("at") + 1).alias("depth"), (F.col("at") + 1 + F.col("heavy_size") + F.col("o")).alias("pre"))
    heads = marked.where("up is null").select("v", F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pre")).unionByName(light)
    heads = _climb(scratch.cut(heads, "heads"), scratch, ["depth", "pre"]).select(F.col("v").alias("chain"), F.col("top").alias("root"), F.col("depth").alias("d"), F.col("pre").alias("s"))
    flat = chains.join(heads, "chain").join(marked.select("v", "up", "size"), "v")
    flat = flat.select("v", "up", "root", (F.col("d") + F.col("pos")).alias("depth"), "chain", "pos", "size", (F.col("s") + F.col("pos")).alias("pre"), F.lit(False).alias("endless"))
    loops = endless.join(_cycle_roots(endless, scratch), "v")
    none = F.lit(None).cast("long")
    loops = loops.select("v", "up", "root", none.alias("depth"), F.lit(None).cast("string").alias("chain"), none.alias("pos"), none.alias("size"), none.alias("pre"), F.lit(True).alias("endless"))
    return flat.unionByName(loops)


def paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Add ``path``, the ids from the root to the node, to the result of ``hierarchy``; null where endless.

    A chain's prefix is its parent chain's prefix and that chain's nodes down to the joint.
    """
    nodes = scratch.cut(nodes, "hierarchy")
    finite = nodes.where("not endless")
    chains = scratch.cut(finite.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("members")), "members")
    joint = finite.where("pos = 0 and up is not null").select("chain", "up").join(finite.select(F.col("v").alias("up"), F.col("chain").alias("over"), F.col("pos").alias("at")), "up").select("chain", "over", "at")
    joint = scratch.cut(joint, "joints")
    front = chains.join(joint, "chain", "left_anti").select("chain", "members", F.array().cast(T.ArrayType(T.StringType())).alias("prefix"))
    levels = []
    while True:
        front = scratch.cut(front, "prefix")
        if front.isEmpty():
            break
        levels.append(front)
        above = front.select(F.col("chain").alias("over"), F.col("members").alias("m"), F.col("prefix").alias("p"))
        front = joint.join(above, "over").select("chain", F.concat("p", F.slice("m", 1, F.col("at").cast("int") + 1)).alias("prefix")).join(chains, "chain").select("chain", "members", "prefix")
    known = front
    for x in levels:
        known = known.unionByName(x)
    full = finite.join(known, "chain").withColumn("path", F.concat("prefix", F.slice("members", 1, F.col("pos").cast("int") + 1))).select(*nodes.columns, "path")
    return full.unionByName(nodes.where("endless").withColumn("path", F.lit(None).cast(T.ArrayType(T.StringType()))))


def _within(intervals: DataFrame, nodes: DataFrame) -> DataFrame:
    """``v, descendant, distance`` for ``v, root, lo, hi, depth``: the other nodes of ``root`` with ``pre`` in ``[lo, hi)``.

    The nodes of a root are dense in preorder. They are listed by ``CHUNK`` positions; an interval meets the lists it overlaps
    by an equi-join and takes a slice of each, so a pair becomes a row only after the join.
    """
    at = F.floor(F.col("pre") / CHUNK).cast("long")
    lists = nodes.groupBy("root", at.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pre", F.col("v").alias("d"), F.col("depth").alias("below")))).alias("members"))
    each = intervals.where("hi > lo").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK).cast("long"), F.floor((F.col("hi") - 1) / CHUNK).cast("long"))))
    first = F.greatest(F.col("lo") - F.col("chunk") * CHUNK, F.lit(0)).cast("int")
    last = F.least(F.col("hi") - F.col("chunk") * CHUNK, F.lit(CHUNK)).cast("int")
    met = each.join(lists, ["root", "chunk"]).select("v", "depth", F.explode(F.slice("members", first + 1, last - first)).alias("x"))
    return met.select("v", F.col("x.d").alias("descendant"), (F.col("x.below") - F.col("depth")).alias("distance")).where("v <> descendant")


def descendants(nodes: DataFrame) -> DataFrame:
    """``v, descendant, distance``: every pair of blocks whose way up ends, from the intervals of ``hierarchy``."""
    trees = nodes.where("not endless")
    return _within(trees.where("size > 1").select("v", "root", (F.col("pre") + 1).alias("lo"), (F.col("pre") + F.col("size")).alias("hi"), "depth"), trees)


def endless_descendants(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``v, descendant``: every other block on whose endless way up ``v`` lies.

    With the cycles cut, each block on a cycle is the root of a tree. A block off the cycle has its interval
    there; one on the cycle has all trees of its cycle.
    """
    loops = scratch.cut(nodes.where("endless").select("v", "up"), "loops")
    if loops.isEmpty():
        return loops.select("v", F.col("up").alias("descendant"))
    cyclic = scratch.cut(_cycle_windows(loops, scratch).select(F.col("p").alias("v"), F.col("m2").alias("loop")).distinct(), "cyclic")
    open_ = loops.join(cyclic.select("v", F.lit(True).alias("on")), "v", "left").select("v", F.when(F.col("on").isNull(), F.col("up")).alias("up"))
    trees = scratch.cut(hierarchy(scratch.cut(open_, "opened"), scratch), "opened_trees")
    tops = cyclic.join(trees.where("up is null").select("v", "size"), "v")
    own = trees.where("up is not null").select("v", "root", F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi"), "depth")
    every = cyclic.join(tops.select("loop", F.col("v").alias("root"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi")), "loop")
    return _within(own.unionByName(every.select("v", "root", "lo", "hi", F.lit(None).cast("long").alias("depth"))), trees).select("v", "descendant")
