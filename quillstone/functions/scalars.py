"""Column expressions of the record model: texts, strength over time, tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.wordlists import NOISE, entries

# Decay per hour by record type; anything else decays like a fact.
DECAY_RATES = {"entity": 0.001, "fact": 0.005, "relation": 0.005, "preference": 0.02, "event": 0.04, "experience": 0.002, "episode": 0.0}
#: Letters, digits and underscores in any script.
TOKEN = r"[\p{L}\p{N}_]+"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition; Spark has no expression for it."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalised(text: Column) -> Column:
    """Composed, trimmed, lower case, white space collapsed."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(nfc(text)), r"\s+", " ")), " +", " ")


def content_hash(text: Column, kind: Column | None = None, happened_at: Column | None = None) -> Column:
    """SHA-256 of the normalised text; events that happened at a known time hash that time too."""
    plain = normalised(text)
    if kind is None:
        return F.sha2(plain, 256)
    timed = F.concat(plain, F.lit("\x1f"), F.date_format(happened_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.sha2(F.when((kind == "event") & happened_at.isNotNull(), timed).otherwise(plain), 256)


def tokens(text: Column) -> Column:
    """Lower-case tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(text) / 4)


def hours_between(earlier: Column, later: Column) -> Column:
    """Hours, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9)


def default_rate(kind: Column) -> Column:
    out = F.lit(DECAY_RATES["fact"])
    for name, rate in DECAY_RATES.items():
        out = F.when(kind == name, F.lit(rate)).otherwise(out)
    return out


def strength(confidence: Column, rate: Column, created_at: Column, access_count: Column, last_accessed: Column, as_of: Column) -> Column:
    """Confidence decayed since creation and lifted by recent use, within 0 and 1."""
    decayed = confidence * F.exp(-rate * hours_between(created_at, as_of))
    recent = F.when(last_accessed.isNull(), 1.0).otherwise(F.exp(-0.01 * hours_between(last_accessed, as_of)))
    boost = F.when(access_count > 0, 1 + 0.3 * F.log1p(access_count.cast("double")) * recent).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), decayed * boost))


def recency(created_at: Column, as_of: Column) -> Column:
    """1 now, 0 after 30 days."""
    return F.greatest(F.lit(0.0), 1 - hours_between(created_at, as_of) / 720)


def question_text(text: Column) -> Column:
    """A question's key: composed, trimmed, lower case, one space between words, no closing punctuation."""
    return F.regexp_replace(normalised(text), r"[?!.,;:]+$", "")


def is_noise(text: Column, more: list[str] | None = None, fewer: list[str] | None = None) -> Column:
    """Texts of under 3 characters, greetings and fillers; ``more`` adds words of the caller's, ``fewer`` takes some away."""
    key = F.regexp_replace(F.trim(F.lower(text)), r"[?!.,;:]+$", "")
    words = {*entries(NOISE), *(w.lower() for w in more or [])} - {w.lower() for w in fewer or []}
    return (F.length(key) < 3) | key.isin(sorted(words))


def band(confidence: Column) -> Column:
    """Label of a strength."""
    return F.when(confidence >= 0.9, "HIGH").when(confidence >= 0.7, "MED").when(confidence >= 0.4, "LOW").otherwise("WEAK")
