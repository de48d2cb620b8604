"""Entities named in questions and records: capitalised words and phrases, quotations, what follows telling words.

Lists are in order of the rules, then of appearance; an entity counts once whatever its case; words of ``NO_ENTITY`` and of under 3 characters are none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions.wordlists import NO_ENTITY, entries

_NAME = r"[A-Z][a-z]+"
_RUN = rf"{_NAME}(?:\s+{_NAME})"
# Words that a name follows in records, and that one of three words after is a name in questions.
BEFORE = ["named", "called", "at", "to", "from", "with", "about", "visiting", "visited"]
ASKING = ["does", "did", "is", "was", "would", "could", "has", "have"]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def _kept(found: Column) -> Column:
    """Trimmed, without stop words and short ones, the first of each in whatever case."""
    no = F.array(*[F.lit(w) for w in entries(NO_ENTITY)])
    good = F.filter(F.transform(found, lambda e: F.trim(e)), lambda e: (F.length(e) > 2) & ~F.array_contains(no, F.lower(e)))
    low = F.transform(good, F.lower)
    return F.filter(good, lambda e, i: F.array_position(low, F.lower(e)) == i + 1)


def of_question(text: Column) -> Column:
    """Phrases of capitalised words, such words alone, quotations, and capitalised words after an auxiliary verb."""
    after = _all(text, rf"(?i)(?:{'|'.join(ASKING)})\s+(\w+(?:\s+\w+){{0,2}})")
    after = F.filter(F.flatten(F.transform(after, lambda p: F.split(p, r"\s+"))), lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))
    return F.coalesce(_kept(F.concat(_all(text, rf"\b({_RUN}+)\b"), _all(text, r"\b([A-Z][a-z]{2,})\b"), _all(text, '"([^"]{3,60})"'), after)), F.array().cast("array<string>"))


def of_record(text: Column, kind: Column) -> Column:
    """As of a question, and: an entity record's first sentence, phrases within long quotations, names after ``BEFORE``, possessives."""
    quoted = _all(text, '"([^"]{3,80})"')
    short = F.filter(quoted, lambda q: F.length(q) <= 40)
    inner = F.flatten(F.transform(F.filter(quoted, lambda q: F.length(q) > 40), lambda q: _all(q, rf"\b({_RUN}*)\b")))
    own = F.when(kind == "entity", F.array(F.split(text, r"\.")[0])).otherwise(F.array().cast("array<string>"))
    told = _all(text, rf"(?:{'|'.join(BEFORE)})\s+({_RUN}*)")
    owners = _all(text, rf"\b({_NAME})'s\b")
    return F.coalesce(_kept(F.concat(_all(text, rf"\b({_RUN}+)\b"), _all(text, r"\b([A-Z][a-z]{2,})\b"), own, short, inner, told, owners)), F.array().cast("array<string>"))
