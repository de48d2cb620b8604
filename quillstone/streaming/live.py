"""Structured Streaming twins of the running figures. Late rows are dropped by the watermark."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import questions
from quillstone.operators.trouble import Detector


def running_counters(asked: DataFrame) -> DataFrame:
    """Times asked per organisation and question so far, and the latest time; for update or complete mode.

    The state is one row per question asked. Exact users per question are those of ``first_asks``, counted by its reader.
    """
    kept = questions.cleaned(asked)
    return kept.groupBy("org_id", "question").agg(F.count("*").alias("frequency"), F.max("asked_at").alias("last_asked"))


def first_asks(asked: DataFrame, late: str = "1 day") -> DataFrame:
    """The first time that each user asked each question, for append mode; what a user asked is forgotten ``late`` after the watermark."""
    kept = questions.cleaned(asked).withWatermark("asked_at", late)
    return kept.dropDuplicatesWithinWatermark(["org_id", "question", "user_id"]).select("org_id", "question", "user_id", "asked_at")


def per_day(asked: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling days."""
    w = F.window("asked_at", "1 day")
    return asked.withWatermark("asked_at", late).groupBy("org_id", w.alias("w")).agg(F.count("*").alias("n")).select("org_id", F.col("w.start").alias("day"), "n")


def recent_rate(asked: DataFrame, days: int = 7, late: str = "1 hour") -> DataFrame:
    """Counts in windows of ``days`` that slide by a day."""
    w = F.window("asked_at", f"{days} days", "1 day")
    return asked.withWatermark("asked_at", late).groupBy("question", w.alias("w")).agg(F.count("*").alias("n")).select("question", F.col("w.end").alias("until"), (F.col("n") / days).alias("per_day"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events grouped to sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "n")


def once(writes: DataFrame, receipt: str = "receipt", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """Writes whose receipt was not seen before."""
    return writes.withWatermark(at, late).dropDuplicatesWithinWatermark([receipt])


def trouble(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """``session_id, failed_in_a_row`` whenever a session's run of failed calls reaches a multiple of ``threshold``.

    ``calls`` has ``session_id, n, failed``; ``n`` orders the calls of a session within a batch.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        run, out = (state.get[0] if state.exists else 0), []
        rows = pd.concat(list(batches)).sort_values("n")
        for failed in rows["failed"]:
            run = run + 1 if failed else 0
            if run and run % threshold == 0:
                out.append(run)
        state.update((run,))
        yield pd.DataFrame({"session_id": [key[0]] * len(out), "failed_in_a_row": out}).astype({"failed_in_a_row": "int32"})

    return calls.groupBy("session_id").applyInPandasWithState(step, "session_id string, failed_in_a_row int", "run int", "append", "NoTimeout")


def orphans(events: DataFrame) -> DataFrame:
    """Changes of the number of waiting references: ``key, ref_table, ref_field, month, reason, waiting``, in update mode.

    ``events`` has ``key, kind, ref_table, ref_field, at, n``: a reference (``ref``), an arriving parent (``parent``) or a deletion
    (``delete``); ``n`` orders the events of a key within a batch. A reference waits while its parent is absent, was created after ``at``
    (early), or is deleted; an arriving parent resolves, a deletion reopens and holds, also for later references and parents. The state of a
    key counts its references by table, field and time, so copies cost nothing.
    """

    def waiting(refs: dict[str, int], born: float | None, seen: bool, gone: bool) -> dict[tuple, int]:
        out: dict[tuple, int] = {}
        for name, n in refs.items():
            ref_table, field, at = json.loads(name)
            reason = "absent" if not seen else "early" if born is not None and at is not None and born > at else "deleted" if gone else None
            if reason:
                month = None if at is None else pd.Timestamp(at, unit="s").strftime("%Y-%m")
                out[ref_table, field, month, reason] = out.get((ref_table, field, month, reason), 0) + n
        return out

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held, born, seen, gone = state.get if state.exists else ("{}", None, False, False)
        refs = json.loads(held)
        before = waiting(refs, born, seen, gone)
        for e in pd.concat(list(batches)).sort_values("n").itertuples():
            at = None if pd.isna(e.at) else e.at.timestamp()
            if e.kind == "ref":
                name = json.dumps([e.ref_table, e.ref_field, at])
                refs[name] = refs.get(name, 0) + 1
            elif e.kind == "parent":
                born, seen = (at if born is None or at is not None and at < born else born), True
            elif e.kind == "delete":
                gone = True
        state.update((json.dumps(refs), born, seen, gone))
        now = waiting(refs, born, seen, gone)
        rows = [(key[0], *k, now.get(k, 0)) for k in sorted({*before, *now}, key=str) if now.get(k) != before.get(k)]
        if rows:
            yield pd.DataFrame(rows, columns=["key", "ref_table", "ref_field", "month", "reason", "waiting"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, ref_table string, ref_field string, month string, reason string, waiting bigint", "refs string, born double, seen boolean, gone boolean", "update", "NoTimeout")


def stuck(calls: DataFrame, failures: int = 2, empties: int = 2, repeats: int = 3) -> DataFrame:
    """``session_id, n, trouble`` of calls ``session_id, n, name, arguments, content, is_error``: the detector of ``operators.trouble`` as it goes.

    ``n`` orders the calls of a session within a batch. The state of a session is its counters.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        detector = Detector(failures, empties, repeats)
        if state.exists:
            detector.runs, detector.calls = json.loads(state.get[0])
        out = []
        for c in pd.concat(list(batches)).sort_values("n").itertuples():
            found = detector.observe(c.name, c.arguments, c.content, None if pd.isna(c.is_error) else bool(c.is_error))
            if found:
                out.append((key[0], c.n, found))
        state.update((json.dumps([detector.runs, detector.calls]),))
        yield pd.DataFrame(out, columns=["session_id", "n", "trouble"])

    return calls.groupBy("session_id").applyInPandasWithState(step, "session_id string, n bigint, trouble string", "counters string", "append", "NoTimeout")


def every(messages: DataFrame, size: int) -> DataFrame:
    """``session_id, batch, text``: a session's messages ``session_id, n, line``, whenever ``size`` have come together."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        done, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        for line in pd.concat(list(batches)).sort_values("n")["line"]:
            held.append(line)
            if len(held) == size:
                out.append((key[0], done, "\n".join(held)))
                done, held = done + 1, []
        state.update((done, held))
        yield pd.DataFrame(out, columns=["session_id", "batch", "text"]).astype({"batch": "int32"})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, batch int, text string", "done int, held array<string>", "append", "NoTimeout")


def expired(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``key, at``: keys whose time to live is over. ``events`` has ``key, at, ttl`` (seconds); each event of a key starts its time anew.

    A key expires once the watermark passes its last event's time by ``ttl``.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            until = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "at": pd.to_datetime([until], unit="ms")})
            return
        until = state.get[0] if state.exists else 0
        for b in batches:
            until = max(until, *(int(t.timestamp() * 1000 + 1000 * n) for t, n in zip(b["at"], b["ttl"], strict=True)))
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "until bigint", "append", "EventTimeTimeout")
