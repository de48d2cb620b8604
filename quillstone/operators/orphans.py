"""References to records that do not exist, kept as keyed state.

``OrphanState`` holds an index of the keys seen so far, as parents or as deletions, the references that found theirs
(``settled``) and the ``pending`` ones with a reason. New references probe the index with the parents and deletions
of their batch; so do waiting ones, since a parent may arrive, also with an earlier time; deletions reopen what
had been settled. In which batches the rows come makes no difference. Every step is one equi-join on the key; a hot key lies on the many side, whose
partition adaptive execution splits, against a parent side with one row per key.

Defined results: null and empty keys are no references; repeated references are kept (the reports
count distinct rows); a parent in several rows is one, created at its earliest time, deleted if any
row is or a deletion names it, before or after it comes; a reference without a time is never early; a parent without a time is never late; a deletion of an
unknown key is kept for a parent that may still come; empty inputs give empty states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.scratch import Scratch

REF = "ref_table string, row_id string, ref_field string, key string, at timestamp"


def references(df: DataFrame, name: str, row_id: str, fields: list[str], at: str | None) -> DataFrame:
    """``ref_table, row_id, ref_field, key, at`` of the named fields, in one pass over ``df``."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("k")) for f in fields]))
    when = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
    out = df.select(F.col(row_id).alias("row_id"), when.alias("at"), each.alias("x"))
    return out.where("x.k is not null and x.k <> ''").select(F.lit(name).alias("ref_table"), "row_id", F.col("x.f").alias("ref_field"), F.col("x.k").alias("key"), "at")


@dataclass
class OrphanState:
    """Parent index and references by state; ``apply`` returns the next state, written to ``scratch``.

    ``parents`` has ``id, created_at, seen, deleted``: ``seen`` is false while only a deletion named the key.
    """

    scratch: Scratch
    parents: DataFrame
    settled: DataFrame
    pending: DataFrame
    may_dangle: tuple[str, ...] = ()

    @classmethod
    def empty(cls, spark: SparkSession, scratch: Scratch) -> OrphanState:
        refs = spark.createDataFrame([], REF)
        return cls(scratch, spark.createDataFrame([], "id string, created_at timestamp, seen boolean, deleted boolean"), refs, refs.withColumn("reason", F.lit("absent")))

    def apply(self, refs: DataFrame | None = None, parents: DataFrame | None = None, deletions: DataFrame | None = None, may_dangle: list[str] | None = None) -> OrphanState:
        """The state after one batch. ``parents`` has ``id, created_at``, ``deletions`` has ``id``.

        References from the tables in ``may_dangle`` may name deleted parents, in this batch and in later ones.
        """
        free = tuple(sorted({*self.may_dangle, *(may_dangle or [])}))
        index, settled, pending = self.parents, self.settled, self.pending
        new = []
        if parents is not None:
            new.append(parents.select("id", F.col("created_at").cast("timestamp").alias("created_at"), F.lit(True).alias("seen"), F.lit(False).alias("deleted")))
        if deletions is not None:
            new.append(deletions.select("id", F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("seen"), F.lit(True).alias("deleted")))
        if new:
            every = new[0] if index.isEmpty() else index.unionByName(new[0])
            for x in new[1:]:
                every = every.unionByName(x)
            index = self.scratch.cut(every.where("id is not null").groupBy("id").agg(F.min("created_at").alias("created_at"), F.bool_or("seen").alias("seen"), F.bool_or("deleted").alias("deleted")), "parents")
        again = (F.col("reason") != "deleted") | F.col("ref_table").isin(*free)
        waiting = pending.where(again).drop("reason")
        probing = refs if waiting.isEmpty() else waiting if refs is None else refs.unionByName(waiting)
        if probing is not None:
            reason = F.when(F.col("id").isNull() | ~F.col("seen"), "absent").when(F.col("created_at") > F.col("at"), "early").when(F.col("deleted") & ~F.col("ref_table").isin(*free), "deleted")
            probed = self.scratch.cut(probing.join(index, F.col("key") == F.col("id"), "left").select(*probing.columns, reason.alias("reason")), "probed")
        if deletions is not None and not settled.isEmpty():
            gone = deletions.select("id").where("id is not null").distinct()
            bound = settled.where(~F.col("ref_table").isin(*free))
            bound = self.scratch.cut(bound.join(gone, F.col("key") == F.col("id"), "left").select(*settled.columns, F.col("id").isNotNull().alias("gone")), "bound")
            settled = bound.where("not gone").drop("gone").unionByName(settled.where(F.col("ref_table").isin(*free)))
            pending = pending.unionByName(bound.where("gone").drop("gone").withColumn("reason", F.lit("deleted")))
        if probing is not None:
            kept, found = pending.where(~again), probed.where("reason is null").drop("reason")
            settled = found if settled.isEmpty() else settled.unionByName(found)
            opened = probed.where("reason is not null")
            pending = opened if kept.isEmpty() else kept.unionByName(opened)
        return OrphanState(self.scratch, index, settled, pending, free)

    def cases(self) -> DataFrame:
        """Distinct ``ref_table, row_id, ref_field`` of the pending references."""
        return self.pending.select("ref_table", "row_id", "ref_field").distinct()

    def report(self) -> DataFrame:
        """Snapshot of the pending references: distinct rows by table, field and month (null without a time)."""
        month = F.date_format("at", "yyyy-MM").alias("month")
        one = self.pending.select("ref_table", "ref_field", "reason", "row_id", "key", "at").distinct()
        return one.groupBy("ref_table", "ref_field", month, "reason").agg(F.count("*").alias("n_orphans"))
