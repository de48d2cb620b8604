"""Queries over the data-pipeline problems of the core: hierarchies, orphan references, change feeds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import changefeed, hierarchy, orphans
from quillstone.plans.scratch import Scratch
from quillstone.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "p1")
    nodes = hierarchy.hierarchy(hierarchy.resolve_parents(table(spark, folder, "blocks"), scratch), scratch)
    return nodes.where("up is not null").select(F.col("v").alias("block_id"), F.col("root").alias("root_id"))


def p1_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Every block with its path, depth, root and number of descendants; ``p1_descendants`` gives the descendants."""
    scratch = Scratch(spark, "p1")
    nodes = hierarchy.paths(hierarchy.hierarchy(hierarchy.resolve_parents(table(spark, folder, "blocks"), scratch), scratch), scratch)
    return nodes.select(F.col("v").alias("block_id"), F.col("up").alias("parent"), F.col("root").alias("root_id"), "depth", F.concat_ws("/", "path").alias("path"), (F.col("size") - 1).alias("n_descendants"), F.col("endless").alias("is_endless"))


def p1_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every block with each of its descendants, also on and below cycles; there is no row for blocks without descendants."""
    scratch = Scratch(spark, "p1")
    nodes = scratch.cut(hierarchy.hierarchy(hierarchy.resolve_parents(table(spark, folder, "blocks"), scratch), scratch), "hierarchy")
    pairs = hierarchy.descendants(nodes).select("v", "descendant").unionByName(hierarchy.endless_descendants(nodes, scratch))
    return pairs.select(F.col("v").alias("block_id"), F.col("descendant").alias("descendant_id"))


#: Periods of equal length, from the first to the last created block, in which the rows of problem 4 arrive.
PERIODS = 4


def _arrivals(spark: SparkSession, folder: str) -> Iterator[orphans.OrphanState]:
    """The state after each period. What has no time comes in the first one, deletions, which have none, come in the last."""
    blocks = table(spark, folder, "blocks").select("id", F.col("created_at").cast("timestamp").alias("created_at"), "deleted")
    first, last = blocks.agg(F.unix_micros(F.min("created_at")), F.unix_micros(F.max("created_at"))).first()
    first, last = first or 0, last or 0
    edge = [first + -(-(last - first + 1) * i // PERIODS) for i in range(1, PERIODS)]
    sources = [("edges", "id", ["source_id", "target_id"], "created_at"), ("operations", "id", ["block_id"], "timestamp"), ("block_embeddings", "block_id", ["block_id"], None)]

    def within(df: DataFrame, at: str | None, i: int) -> DataFrame:
        if at is None:
            return df if i == 0 else df.limit(0)
        c, moment = F.col(at).cast("timestamp"), lambda us: F.timestamp_micros(F.lit(us))
        low = c >= moment(edge[i - 1]) if i else F.lit(True)
        high = c < moment(edge[i]) if i < PERIODS - 1 else F.lit(True)
        return df.where(low & high if i else c.isNull() | high)

    state = orphans.OrphanState.empty(spark, Scratch(spark, "p4"))
    for i in range(PERIODS):
        refs = None
        for name, row_id, fields, at in sources:
            if at is not None or i == 0:
                new = orphans.references(within(table(spark, folder, name), at, i), name, row_id, fields, at)
                refs = new if refs is None else refs.unionByName(new)
        gone = blocks.where("deleted") if i == PERIODS - 1 else None
        state = state.apply(refs=refs, parents=within(blocks, "created_at", i), deletions=gone, may_dangle=["operations"])
        yield state


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    *_, state = _arrivals(spark, folder)
    return state.cases()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Pending references by table, field, month and reason."""
    *_, state = _arrivals(spark, folder)
    return state.report()


def p4_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots: the references pending at the end of each period, by table, field and reason."""
    out = None
    for i, state in enumerate(_arrivals(spark, folder)):
        new = state.report().groupBy("ref_table", "ref_field", "reason").agg(F.sum("n_orphans").alias("n_orphans")).withColumn("period", F.lit(i))
        out = new if out is None else out.unionByName(new)
    return out


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.replay(table(spark, folder, "operations")).select("block_id", "clock")


def p7_state(spark: SparkSession, folder: str) -> DataFrame:
    """The current blocks with their data as JSON text."""
    return changefeed.replay(table(spark, folder, "operations"))


_PARENTS = """
nodes AS (SELECT id, max(parent_id) AS p FROM blocks WHERE id IS NOT NULL GROUP BY id),
listed AS (SELECT child, min(id) AS lister FROM (SELECT id, unnest(children_ids) AS child FROM blocks) WHERE child IS NOT NULL GROUP BY child),
par AS (SELECT n.id, coalesce(o.id, l.lister) AS up FROM nodes n LEFT JOIN nodes o ON n.p = o.id LEFT JOIN listed l ON l.child = n.id)"""

_TREES = f"""WITH RECURSIVE {_PARENTS},
tree AS (
  SELECT id, up, id AS root, 0 AS depth, id AS path FROM par WHERE up IS NULL
  UNION ALL SELECT p.id, p.up, t.root, t.depth + 1, t.path || '/' || p.id FROM par p JOIN tree t ON p.up = t.id),
loops AS (SELECT id, up FROM par WHERE up IS NOT NULL AND id NOT IN (SELECT id FROM tree)),
reach AS (SELECT id, up AS spot FROM loops UNION SELECT r.id, l.up FROM reach r JOIN loops l ON r.spot = l.id),
oncycle AS (SELECT id FROM reach WHERE id = spot),
looproot AS (SELECT r.id, min(r.spot) AS root FROM reach r JOIN oncycle c ON r.spot = c.id GROUP BY r.id),
below AS (SELECT anc, count(*) - 1 AS n FROM (SELECT unnest(string_split(path, '/')) AS anc FROM tree) GROUP BY anc)"""

_REFS = """
WITH refs AS (
  SELECT 'edges' AS ref_table, id AS row_id, 'source_id' AS ref_field, source_id AS key, created_at AS ref_time FROM edges
  UNION ALL SELECT 'edges', id, 'target_id', target_id, created_at FROM edges
  UNION ALL SELECT 'operations', id, 'block_id', block_id, timestamp FROM operations
  UNION ALL SELECT 'block_embeddings', block_id, 'block_id', block_id, NULL FROM block_embeddings),
one AS (SELECT id, min(created_at) AS created_at, bool_or(deleted) AS deleted FROM blocks GROUP BY id),
cases AS (SELECT r.*, CASE WHEN b.id IS NULL THEN 'absent' WHEN b.created_at > r.ref_time THEN 'early'
    WHEN b.deleted AND r.ref_table <> 'operations' THEN 'deleted' END AS reason
  FROM refs r LEFT JOIN one b ON r.key = b.id WHERE r.key IS NOT NULL AND r.key <> '')"""

_FEED = """
WITH ops AS (SELECT DISTINCT block_id, clock, timestamp, id, lower(trim(action)) AS action, data FROM operations
  WHERE block_id <> '' AND clock IS NOT NULL),
valid AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY clock, timestamp NULLS FIRST, id NULLS FIRST) AS n FROM ops
  WHERE action = 'delete' OR action IN ('create', 'update') AND json_valid(data) AND json_type(CASE WHEN json_valid(data) THEN data END) = 'OBJECT'),
reset AS (SELECT block_id, max(n) AS n, max_by(action, n) AS action FROM valid WHERE action <> 'update' GROUP BY block_id)"""

QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p4_found": p4_found, "p4_report": p4_report, "p4_periods": p4_periods, "p7_found": p7_found, "p7_state": p7_state}

ORACLES = {
    "p1_found": _TREES + """
SELECT id AS block_id, root AS root_id FROM tree WHERE up IS NOT NULL UNION ALL SELECT id, root FROM looproot""",
    "p1_hierarchy": _TREES + """
SELECT t.id AS block_id, t.up AS parent, t.root AS root_id, CAST(t.depth AS BIGINT) AS depth, t.path AS path, b.n AS n_descendants, false AS is_endless
FROM tree t JOIN below b ON t.id = b.anc
UNION ALL SELECT l.id, l.up, r.root, NULL, '', NULL, true FROM loops l JOIN looproot r ON l.id = r.id""",
    "p1_descendants": _TREES + """
SELECT anc AS block_id, id AS descendant_id FROM (SELECT id, unnest(string_split(path, '/')) AS anc FROM tree) WHERE anc <> id
UNION ALL SELECT spot, id FROM reach WHERE spot <> id""",
    "p4_found": _REFS + " SELECT DISTINCT ref_table, row_id, ref_field FROM cases WHERE reason IS NOT NULL",
    "p4_report": _REFS + """
SELECT ref_table, ref_field, month, reason, count(*) AS n_orphans
FROM (SELECT DISTINCT ref_table, row_id, ref_field, key, ref_time, strftime(ref_time, '%Y-%m') AS month, reason FROM cases WHERE reason IS NOT NULL)
GROUP BY ALL""",
    "p4_periods": f"""
WITH span AS (SELECT epoch_us(min(created_at)) AS lo, epoch_us(max(created_at)) - epoch_us(min(created_at)) + 1 AS wide FROM blocks),
refs AS (
  SELECT 'edges' AS ref_table, id AS row_id, 'source_id' AS ref_field, source_id AS key, created_at AS ref_time FROM edges
  UNION ALL SELECT 'edges', id, 'target_id', target_id, created_at FROM edges
  UNION ALL SELECT 'operations', id, 'block_id', block_id, timestamp FROM operations
  UNION ALL SELECT 'block_embeddings', block_id, 'block_id', block_id, NULL FROM block_embeddings),
came AS (SELECT DISTINCT refs.*, CASE WHEN ref_time IS NULL THEN 0 ELSE greatest(0, least({PERIODS - 1}, (epoch_us(ref_time) - lo) * {PERIODS} // wide)) END AS arrived FROM refs, span WHERE key <> ''),
one AS (SELECT id, min(created_at) AS created_at, bool_or(deleted) AS deleted, coalesce(min((epoch_us(created_at) - lo) * {PERIODS} // wide), 0) AS arrived FROM blocks, span WHERE id IS NOT NULL GROUP BY id),
cases AS (SELECT p.period, r.*, CASE WHEN b.id IS NULL THEN 'absent' WHEN b.created_at > r.ref_time THEN 'early'
    WHEN b.deleted AND p.period = {PERIODS - 1} AND r.ref_table <> 'operations' THEN 'deleted' END AS reason
  FROM (SELECT CAST(unnest(range({PERIODS})) AS INT) AS period) p JOIN came r ON r.arrived <= p.period LEFT JOIN one b ON r.key = b.id AND b.arrived <= p.period)
SELECT period, ref_table, ref_field, reason, count(*) AS n_orphans FROM cases WHERE reason IS NOT NULL GROUP BY ALL""",
    "p7_found": _FEED + """
SELECT v.block_id, max_by(v.clock, v.n) AS clock FROM valid v JOIN reset r ON v.block_id = r.block_id
WHERE r.action = 'create' AND v.n >= r.n GROUP BY v.block_id""",
}
