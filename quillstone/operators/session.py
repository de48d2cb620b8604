"""Conversations: turns written once as episodes, recall under a budget, the prompt's parts.

Messages are rows ``session_id, turn, seq, role, content, receipt, at``. An episode is a record of type ``episode`` whose custom metadata holds role, turn and seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators import context

# Words without a meaning of their own, for the relevance floor.
MEANINGLESS = """
a about after again all also am an and any are as at be because been before being both but by can could did do does doing don down
during each few for from further had has have having he her here hers him his how i if in into is it its just ll me more most my no nor
not now of off on once only or other our out over own re s same she should so some such t than that the their them then there these
they this those through to too under until up ve very was we were what when where which while who whom why will with would you your yours
""".split()


def content_words(text: Column) -> Column:
    """The different words of a text that carry meaning: of a-z and digits, two and more."""
    none = F.array(*[F.lit(w) for w in MEANINGLESS])
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~F.array_contains(none, w))


def above_floor(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, content`` rows that share a loosely equal content word with their query (``query_id, text``)."""
    same = lambda a, b: F.when(F.least(F.length(a), F.length(b)) <= 3, F.startswith(a, b) | F.startswith(b, a)).otherwise(F.substring(a, 1, 4) == F.substring(b, 1, 4))
    asked = queries.select("query_id", content_words(F.col("text")).alias("_q"))
    joined = results.join(asked, "query_id").withColumn("_w", content_words(F.col("content")))
    return joined.where(F.exists("_q", lambda q: F.exists("_w", lambda w: same(q, w)))).drop("_q", "_w")


def recall(results: DataFrame, queries: DataFrame, budget: int = 1500, most: int = 8, excluded: DataFrame | None = None, hidden_types: tuple[str, ...] = ("experience",), floor: bool = True) -> DataFrame:
    """Ranked results (``query_id, id, rank, type, content, strength``) for a prompt: what is new and relevant, greedily within the budget.

    ``excluded`` has ``query_id, id`` of what the conversation shows anyway.
    """
    rows = results.where(~F.col("type").isin(*hidden_types))
    if "encrypted" in results.columns:
        rows = rows.where(~F.coalesce("encrypted", F.lit(False)))
    if excluded is not None:
        rows = rows.join(excluded.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti")
    if floor:
        rows = above_floor(rows, queries)
    return context.greedy(context.lines(rows), budget, most)


def episodes(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Messages as episode records, each receipt once: of equal receipts the first by turn and seq, none that is in ``known`` (``receipt``)."""
    w = Window.partitionBy("receipt").orderBy("turn", "seq", "content", "session_id")
    once = messages.where("receipt is null").unionByName(messages.where("receipt is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
    if known is not None:
        once = once.join(known.select("receipt").distinct(), "receipt", "left_anti").select(messages.columns)
    key = F.concat_ws("\x1f", "session_id", F.col("turn").cast("string"), F.col("seq").cast("string"), "role", "content")
    meta = F.to_json(F.struct(F.col("role").alias("_role"), F.col("turn").alias("_turn"), F.col("seq").alias("_seq")))
    return once.select(F.concat(F.lit("blk_"), F.substring(F.sha2(key, 256), 1, 12)).alias("id"), F.lit("episode").alias("type"), "content", "session_id", F.col("at").alias("created_at"), meta.alias("custom_metadata"), "receipt")


def next_turn(blocks: DataFrame) -> DataFrame:
    """``session_id, turn``: one more than the last turn of each session's episodes; 0 where none has a turn."""
    turn = F.get_json_object("custom_metadata", "$._turn").try_cast("int")
    return blocks.where("type = 'episode' and session_id is not null").groupBy("session_id").agg((F.coalesce(F.max(turn), F.lit(-1)) + 1).alias("turn"))


def recent_turns(blocks: DataFrame, turns: int = 6) -> DataFrame:
    """The episodes of each session's last ``turns`` turns, oldest first: ``session_id, place, role, content``."""
    field = lambda name: F.get_json_object("custom_metadata", f"$.{name}")
    rows = blocks.where("type = 'episode' and session_id is not null and not coalesce(deleted, false)").select("session_id", "id", field("_role").alias("role"), field("_turn").try_cast("int").alias("turn"), field("_seq").try_cast("int").alias("seq"), "content")
    last = rows.groupBy("session_id").agg(F.max("turn").alias("last"))
    kept = rows.join(last, "session_id").where(F.col("turn") > F.col("last") - turns)
    return kept.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "seq", "id")).alias("place"), "role", "content")


def reply_text(reply: Column, tool_calls: Column | None = None) -> Column:
    """A model's reply as one text: trimmed, with its tool calls (``array<struct<name, arguments>>``) below."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    if tool_calls is None:
        return text
    calls = F.transform(tool_calls, lambda c: F.concat(F.lit("[call "), c["name"], F.lit(" "), F.coalesce(c["arguments"], F.lit("{}")), F.lit("]")))
    return F.trim(F.concat_ws("\n", F.nullif(text, F.lit("")), F.nullif(F.array_join(F.coalesce(calls, F.array().cast("array<string>")), "\n"), F.lit(""))))


def prompts(recent: DataFrame, recalled: DataFrame | None = None, pinned: DataFrame | None = None) -> DataFrame:
    """``session_id, prompt``: pinned lines, recalled lines (both ``session_id, line, place``), then the recent turns."""
    parts = recent.select("session_id", F.lit(2).alias("part"), "place", F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), "content").alias("line"))
    for n, rows in ((0, pinned), (1, recalled)):
        if rows is not None:
            parts = parts.unionByName(rows.select("session_id", F.lit(n).alias("part"), "place", "line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "line"))), lambda x: x["line"])
    return parts.groupBy("session_id").agg(F.array_join(lines, "\n").alias("prompt"))


def buffered(messages: DataFrame, every: int, flush: bool = False) -> DataFrame:
    """Messages of each session in groups of ``every``: ``session_id, batch, text``; an unfinished group only with ``flush``."""
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "seq")) - 1
    batch = messages.withColumn("batch", F.floor(n / every).cast("int"))
    line = F.concat(F.coalesce("role", F.lit("user")), F.lit(": "), "content")
    out = batch.groupBy("session_id", "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return (out if flush else out.where(F.col("n") == every)).select("session_id", "batch", "text")
