"""Packing ranked results into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scalars

# The types of a grouped context, in order.
GROUPS = ["fact", "preference", "entity", "event", "relation"]


def lines(results: DataFrame) -> DataFrame:
    """Adds ``line`` and its ``cost`` to ``type, content, strength``."""
    line = F.format_string("[%s] (%.2f %s) %s", F.col("type"), F.col("strength"), scalars.band(F.col("strength")), F.coalesce("content", F.lit("")))
    return results.withColumn("line", line).withColumn("cost", scalars.token_estimate(F.col("line")))


def within_budget(ranked: DataFrame, budget: int, header: int = 4) -> DataFrame:
    """Rows of each query up to the first that does not fit; ``rank`` orders them, ``cost`` is charged."""
    spent = F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("spent", spent + header).where(F.col("spent") <= budget)


def greedy(ranked: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """Rows of each query in order, skipping those that do not fit, until ``most`` are taken."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "id", "cost")))
    start = F.struct(F.array().cast("array<string>").alias("ids"), F.lit(0).cast("long").alias("spent"))

    def add(acc, x):  # noqa: ANN001, ANN202
        fits = (acc["spent"] + x["cost"] <= budget) & (F.size(acc["ids"]) < most)
        return F.when(fits, F.struct(F.concat(acc["ids"], F.array(x["id"])).alias("ids"), (acc["spent"] + x["cost"]).alias("spent"))).otherwise(acc)

    taken = ranked.groupBy("query_id").agg(rows.alias("rows")).select("query_id", F.aggregate("rows", start, add).alias("t"))
    return taken.select("query_id", F.posexplode("t.ids").alias("n", "id"), F.col("t.spent").alias("spent"))


def grouped(results: DataFrame, budget: int, each: int = 20) -> DataFrame:
    """The strongest records of every type under a header per type, up to the budget; headers are charged."""
    order = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("type"))
    best = F.row_number().over(Window.partitionBy("query_id", "type").orderBy(F.desc("strength"), "id"))
    rows = lines(results.where(F.col("type").isin(GROUPS))).withColumn("n", best).where(F.col("n") <= each)
    heads = rows.where("n = 1").select("query_id", "type", F.lit(0).alias("n"), F.lit(None).cast("string").alias("id"), F.concat(F.lit("## "), F.initcap("type")).alias("line"))
    heads = heads.withColumn("cost", scalars.token_estimate(F.col("line")))
    every = rows.select("query_id", "type", "n", "id", "line", "cost").unionByName(heads).withColumn("rank", order * 1000 + F.col("n"))
    return within_budget(every, budget)


def confidence_report(results: DataFrame, threshold: float = 0.7) -> DataFrame:
    """How much a context can be relied on."""
    return results.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("strength"), 6).alias("best"), F.round(F.avg("strength"), 6).alias("mean"), F.count_distinct("type").alias("n_types"), (F.max("strength") >= threshold).alias("confident"))


# The header of a context and of one without sufficient evidence.
HEADER, DOUBTFUL = "## Memory Context", "## Memory Context (Low confidence — information may not be available)"


def graph_walk(best: DataFrame, walked: DataFrame, facts: DataFrame) -> DataFrame:
    """``query_id, id, rank, ...`` from the best hit ``query_id, id`` outwards: the hit, then what ``graph.traverse`` reached (``start, id, depth``), near and strong first.

    ``facts`` has ``id, type, content, strength``.
    """
    far = best.select("query_id", F.col("id").alias("start")).join(walked, "start").select("query_id", "id", "depth")
    every = best.select("query_id", "id", F.lit(0).alias("depth")).unionByName(far).groupBy("query_id", "id").agg(F.min("depth").alias("depth")).join(facts, "id")
    order = Window.partitionBy("query_id").orderBy("depth", F.desc("strength"), "id")
    return every.withColumn("rank", F.row_number().over(order))


def adaptive(seeds: DataFrame, live: DataFrame, facts: DataFrame) -> DataFrame:
    """Seeds ``query_id, id`` and their neighbours over ``live`` (``a, b``), by strength and a tenth for each seed that they touch."""
    touched = seeds.select("query_id", F.col("id").alias("a")).distinct().join(live, "a").groupBy("query_id", F.col("b").alias("id")).agg(F.count("*").alias("support"))
    every = touched.unionByName(seeds.select("query_id", "id", F.lit(0).cast("long").alias("support"))).groupBy("query_id", "id").agg(F.max("support").alias("support")).join(facts, "id")
    score = F.round(F.col("strength") + 0.1 * F.col("support"), 6)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return every.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def annotated(rows: DataFrame, edges: DataFrame, facts: DataFrame, most: int = 3) -> DataFrame:
    """``lines`` of the rows with up to ``most`` relations to live records each: the relation and the start of the other's content."""
    good = edges.where("source_id <> '' and target_id <> ''").select("id", "source_id", "target_id", "relation").distinct()
    ends = good.select(F.col("id").alias("edge"), F.col("source_id").alias("id"), F.col("target_id").alias("other"), "relation").unionByName(good.select(F.col("id").alias("edge"), F.col("target_id").alias("id"), F.col("source_id").alias("other"), "relation"))
    ends = ends.join(rows.select("id").distinct(), "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("edge", "other"))).where(F.col("n") <= most)
    brief = F.when(F.length("content") > 50, F.concat(F.substring("content", 1, 50), F.lit("..."))).otherwise(F.col("content"))
    named = ends.join(facts.select(F.col("id").alias("other"), brief.alias("brief")), "other").select("id", "n", F.concat("relation", F.lit(': "'), "brief", F.lit('"')).alias("part"))
    parts = named.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "; ").alias("parts"))
    out = lines(rows).join(parts, "id", "left").withColumn("line", F.concat("line", F.coalesce(F.concat(F.lit(" | related: "), "parts"), F.lit("")))).drop("parts")
    return out.withColumn("cost", scalars.token_estimate(F.col("line")))


def written(rows: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """``query_id, context``: the lines of ``within_budget`` under their header, which says so where ``confidence_report`` finds too little."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n")
    one = rows.groupBy("query_id").agg(text.alias("text"))
    head = F.lit(HEADER)
    if report is not None:
        one = one.join(report.select("query_id", "confident"), "query_id", "left")
        head = F.when(F.col("confident"), HEADER).otherwise(DOUBTFUL)
    return one.select("query_id", F.concat(head, F.lit("\n"), "text").alias("context"))
