"""Agents that are stuck, from their tool results: failures in a row, empty results in a row, the same call again and again.

The three checks hide each other: the first that fires ends the step, so a repetition may be reported later. A session is therefore
folded in order. Its rows stream through one task and only the counters are held, one number per different call.

Defined results: an ``is_error`` that is not null decides failure, else the content's words; null contents are empty; equal places are ordered by
``n`` as given; empty tables give an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Contents that say nothing; what failed calls say, as ends of words and as whole words.
EMPTY = ["", "[]", "{}", "null", "none", "no results", "no results found", "no matches", "no output"]
FAILED_ENDS = ["error", "exception"]
FAILED_WORDS = ["traceback", "fail", "failed", "failure", "fails", "fatal", "panic", "not found", "no such file", "permission denied", "timed out"]
FAILED_EXIT = r"exit (?:code|status) [1-9]\d*"
FAILURE = re.compile(rf"(?:{'|'.join(FAILED_ENDS)})\b|\b(?:{'|'.join(FAILED_WORDS)}|{FAILED_EXIT})\b", re.I)


def call_key(name: str | None, arguments: str | None) -> str:
    """A call by its name and its arguments, whatever the order of their keys."""
    try:
        return f"{name}:{json.dumps(json.loads(arguments or 'null'), sort_keys=True)}"
    except ValueError:
        return f"{name}:{arguments}"


class Detector:
    """Counters of one session; ``observe`` names the trouble that a call completes, if any."""

    def __init__(self, failures: int = 2, empties: int = 2, repeats: int = 3) -> None:
        self.limits = {"failures": failures, "empties": empties, "repeats": repeats}
        self.runs = {"failures": 0, "empties": 0}
        self.calls: dict[str, int] = {}

    def observe(self, name: str | None, arguments: str | None, content: str | None, is_error: bool | None = None) -> str | None:
        failed = bool(is_error) if is_error is not None else bool(FAILURE.search(content or ""))
        now = {"failures": failed, "empties": not failed and (content or "").strip().lower() in EMPTY}
        key = call_key(name, arguments)
        self.calls[key] = self.calls.get(key, 0) + 1
        self.runs = {k: self.runs[k] + 1 if hit else 0 for k, hit in now.items()}
        for kind, run in self.runs.items():
            if run >= self.limits[kind]:
                self.runs[kind] = 0
                return kind
        if self.calls[key] >= self.limits["repeats"]:
            self.calls[key] = 0
            return "repeats"
        return None


def detect(calls: DataFrame, failures: int = 2, empties: int = 2, repeats: int = 3) -> DataFrame:
    """``session_id, n, trouble`` for ``calls`` of ``session_id, n, name, arguments, content, is_error``."""
    kinds = dict(calls.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, detector = object(), None
        for b in batches:
            out = []
            for session, n, name, arguments, content, error in zip(b["session_id"], b["n"], b["name"], b["arguments"], b["content"], b["is_error"], strict=True):
                if session != current:
                    current, detector = session, Detector(failures, empties, repeats)
                found = detector.observe(name, arguments, content, None if pd.isna(error) else bool(error))
                if found:
                    out.append((session, n, found))
            yield pd.DataFrame(out, columns=["session_id", "n", "trouble"])

    rows = calls.select("session_id", "n", "name", "arguments", "content", "is_error").where("session_id is not null")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "n").mapInPandas(fold, f"session_id {kinds['session_id']}, n {kinds['n']}, trouble string")
