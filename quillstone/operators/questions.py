"""Question analytics over events ``org_id, question, user_id, asked_at``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import scalars


def cleaned(asked: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """The events that carry a question, with its key in place of its text; ``noise`` adds words that are none."""
    return asked.where(F.col("question").isNotNull() & ~scalars.is_noise(F.col("question"), noise)).withColumn("question", scalars.question_text(F.col("question")))


def counters(asked: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Per organisation and question: times asked, users, first and last time."""
    return cleaned(asked, noise).groupBy("org_id", "question").agg(F.count("*").alias("frequency"), F.count_distinct("user_id").alias("n_users"), F.min("asked_at").alias("first_asked"), F.max("asked_at").alias("last_asked"))


def _first(found: DataFrame, by: str, limit: int) -> DataFrame:
    """The ``limit`` greatest of every organisation."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("org_id").orderBy(F.desc(by), "question"))).where(F.col("rank") <= limit)


def top(asked: DataFrame, limit: int = 20, since: str | None = None, until: str | None = None) -> DataFrame:
    """The questions that every organisation asked most, by what it asked within a window if one is given.

    ``frequency`` and ``n_users`` count within the window, ``lifetime`` counts everything.
    """
    inside = F.lit(True)
    if since:
        inside = inside & (F.col("asked_at") >= F.lit(since).cast("timestamp"))
    if until:
        inside = inside & (F.col("asked_at") <= F.lit(until).cast("timestamp"))
    asked = cleaned(asked).withColumn("_in", inside)
    user = F.when(F.col("_in"), F.col("user_id"))
    by = asked.groupBy("org_id", "question").agg(F.count_if("_in").alias("frequency"), F.count_distinct(user).alias("n_users"), F.count("*").alias("lifetime"), F.max(F.when(F.col("_in"), F.col("asked_at"))).alias("last_asked"))
    return _first(by.where("frequency > 0"), "frequency", limit)


def trending(asked: DataFrame, as_of: str, window_days: int = 7, limit: int = 10) -> DataFrame:
    """Daily rate in the window over daily rate in life, the greatest of every organisation; questions not asked in the window are left out."""
    now = F.lit(as_of).cast("timestamp")
    recent = F.col("asked_at") >= now - F.expr(f"interval {window_days} days")
    by = cleaned(asked).groupBy("org_id", "question").agg(F.count("*").alias("total"), F.count_if(recent).alias("recent"), F.min("asked_at").alias("first"))
    days = F.greatest(F.lit(1), F.floor((F.unix_micros(now) - F.unix_micros("first")) / 8.64e10))
    score = F.round((F.col("recent") / window_days) / (F.col("total") / days), 6)
    return _first(by.where("recent > 0").select("org_id", "question", "recent", "total", score.alias("score")), "score", limit)


def breakdown(asked: DataFrame, by: str) -> DataFrame:
    """Counts per day, ISO week or month."""
    at = F.col("asked_at")
    if by == "daily":
        key = F.date_format(at, "yyyy-MM-dd")
    elif by == "weekly":
        key = F.format_string("%04d-W%02d", F.expr("extract(YEAROFWEEK from asked_at)"), F.expr("extract(WEEK from asked_at)"))
    elif by == "monthly":
        key = F.date_format(at, "yyyy-MM")
    else:
        raise ValueError("by must be daily, weekly or monthly")
    return cleaned(asked).groupBy("org_id", key.alias("period")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


def stats(asked: DataFrame) -> DataFrame:
    """Unique questions, times asked, users, and the question asked most, by organisation."""
    one = counters(asked)
    users = cleaned(asked).groupBy("org_id").agg(F.count_distinct("user_id").alias("n_users"))
    return one.groupBy("org_id").agg(F.count("*").alias("n_questions"), F.sum("frequency").alias("n_asked"), F.max_by("question", F.struct("frequency", "question")).alias("top_question")).join(users, "org_id")


def rollup(asked: DataFrame) -> DataFrame:
    """Counts by organisation and day, by organisation, and in all."""
    return cleaned(asked).withColumn("day", F.date_format("asked_at", "yyyy-MM-dd")).rollup("org_id", "day").agg(F.count("*").alias("n"))


def trouble(calls: DataFrame, session: str, order: list[str], failed: str, threshold: int = 3) -> DataFrame:
    """Rows at which a run of failed calls in a session reaches a multiple of ``threshold``."""
    w = Window.partitionBy(session).orderBy(*order)  # a session's calls in one task: a session is one agent at work, not a share of the data
    runs = calls.withColumn("_run", F.sum(F.when(F.col(failed), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(session, "_run", failed).orderBy(*order))
    return runs.where(F.col(failed)).withColumn("run_length", place).where(F.col("run_length") % threshold == 0).drop("_run")
