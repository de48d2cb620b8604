"""Sentence units in any script, in SQL expressions alone.

1. Web and mail addresses are masked whole. Quotations inside a sentence get private-use characters for their quotes; marks inside them are masked.
2. Full stops that end nothing - in decimals, addresses, initials, abbreviations, paragraph numbers, before a comma - are masked.
3. A mark is set after every remaining run of terminators with the quotes and brackets closing after it, at blank
   lines, and at spaces between Thai characters; the text is split there.
4. Masks are one character for one character, so places are sums of lengths and ``translate`` restores the text.

Sums run in chunks of ``CHUNK`` units, so that very long texts take linear time; nothing is shuffled.

Defined results: null ids and null, empty or blank texts give no unit; every row is split, repeated ids too; places
count Unicode code points; characters U+E000 to U+E0FF of a text come out as U+FFFD; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 32

# Abbreviations that do not end a sentence, by alphabet.
LATIN = "Gen Rev Hon Capt Col Lt Sgt Maj Gov Sen Mt Ft approx aprox env ca cf vgl vs vol Vol Nr No Nos Fig Figs FIG Abb Tab Tabl tabl Ref Réf réf Sec Pat Pos Corp Ltd Co Dr Mr Mrs Ms Prof St Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec bzw evtl ggf inkl núm Núm pág art Art Sr Sra Dra ed eds EE UU uds min max incl resp Abs Bd Ph al ex ej chap Eq eq".split()
CYRILLIC = "рис Рис см См табл Табл напр др ок пп стр гл им проф".split()
DEVANAGARI = "डॉ सं श्री प्रो".split()
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Abbreviations that end a sentence too, and small words that then begin the next one.
ENDING = "etc usw Inc".split()
STARTERS = "the a an as it in when known this that if one each all when".split()

# The marks that end sentences in Unicode's scripts, as ranges of code points; the full stop is apart.
ENDS = [(0x21, 0x21), (0x3F, 0x3F), (0x2026, 0x2026), (0x589, 0x589), (0x61D, 0x61F), (0x6D4, 0x6D4), (0x700, 0x702), (0x7F9, 0x7F9), (0x837, 0x837), (0x839, 0x839), (0x83D, 0x83E), (0x964, 0x965), (0x104A, 0x104B), (0x1362, 0x1362), (0x1367, 0x1368), (0x166E, 0x166E), (0x1735, 0x1736), (0x17D4, 0x17D5), (0x1803, 0x1803), (0x1809, 0x1809), (0x1944, 0x1945), (0x1AA8, 0x1AAB), (0x1B5A, 0x1B5B), (0x1B5E, 0x1B5F), (0x1C3B, 0x1C3C), (0x1C7E, 0x1C7F), (0x203C, 0x203D), (0x2047, 0x2049), (0x2E2E, 0x2E2E), (0x2E3C, 0x2E3C), (0x3002, 0x3002), (0xA4FF, 0xA4FF), (0xA60E, 0xA60F), (0xA6F3, 0xA6F3), (0xA6F7, 0xA6F7), (0xA876, 0xA877), (0xA8CE, 0xA8CF), (0xA92F, 0xA92F), (0xA9C8, 0xA9C9), (0xAA5D, 0xAA5F), (0xAAF0, 0xAAF1), (0xABEB, 0xABEB), (0xFE52, 0xFE52), (0xFE56, 0xFE57), (0xFF01, 0xFF01), (0xFF1F, 0xFF1F), (0xFF61, 0xFF61)]
_TERMINATORS, _BLANK = "".join(chr(c) for a, z in ENDS for c in range(a, z + 1)), r"[^\S\n]"
#: What parts units, what stands for a masked full stop, and what parts quotations from the rest.
MARK, STOP, PART, WHOLE = "\ue000", "\ue001", "\ue01f", "\ue01e"
#: Opening and closing quotes and the private-use characters that stand for them inside a sentence.
_QUOTES = [("“", "”", "\ue002", "\ue003"), ('"', '"', "\ue004", "\ue005"), ("«", "»", "\ue006", "\ue007"), ("»", "«", "\ue01c", "\ue01d"), ("„", "“", "\ue008", "\ue009"), ("「", "」", "\ue00a", "\ue00b"), ("『", "』", "\ue00c", "\ue00d"), ("（", "）", "\ue00e", "\ue00f")]
_MARKED, _MASKS = "." + _TERMINATORS, STOP + "".join(chr(0xE020 + i) for i in range(len(_TERMINATORS)))
_SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def _inner_quotes(text: Column) -> Column:
    """Private-use quotes around what is quoted inside a sentence, and masked marks within."""
    inside = rf"[^\s.{_TERMINATORS}:;\]\)）】\"”»-]"
    near = rf"{_BLANK}{{0,2}}\n?{_BLANK}{{0,2}}"
    for a, z, p, q in _QUOTES:
        between = rf"(?:{_BLANK}{{1,2}}|{_BLANK}{{0,2}}\n{_BLANK}{{0,2}}|[\(])" if a == '"' else near
        found = rf"（([^（）\n]+)）(?<=[{_MARKED}]）)" if a == "（" else rf"{a}(?<={inside}{between}{a})((?:[^{a}{z}\n]|\n(?!\s*\n))++){z}"
        text = _let(text, lambda t: F.when(F.contains(t, F.lit(a)), F.regexp_replace(t, found, f"{PART}{p}$1{q}{PART}")).otherwise(t))
    opened = F.array(*[F.lit(x[2]) for x in _QUOTES])

    def masked(t: Column) -> Column:
        parts = F.transform(F.split(t, PART), lambda x: F.when(F.array_contains(opened, F.substring(x, 1, 1)), F.translate(x, _MARKED, _MASKS)).otherwise(x))
        return F.array_join(parts, "")

    return _let(text, lambda t: F.when(F.contains(t, F.lit(PART)), masked(t)).otherwise(t))


def _addresses(text: Column) -> Column:
    """Masked marks in web and mail addresses, up to their last letter or digit."""
    tail = r"[^\s<>\"“”«»（）「」]*[\p{L}\p{N}/]"
    web, mail = rf"(?:https?://|ftp://|\bwww\.){tail}", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"

    def masked(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, f"({web}|{mail})", f"{PART}{WHOLE}$1{PART}"), PART)
        return F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit(WHOLE)), F.translate(F.substr(x, F.lit(2)), _MARKED, _MASKS)).otherwise(x)), "")

    return _let(text, lambda t: F.when(t.rlike(r"://|www\.|@"), masked(t)).otherwise(t))


def _masked_stops(text: Column) -> Column:
    """Masks full stops that end nothing."""
    latin = rf"(?<=(?<![A-Za-zÀ-ÿ])(?:{'|'.join(LATIN)})\.)"
    cyrillic = rf"(?<=(?<![А-Яа-яЁё])(?:{'|'.join(CYRILLIC)})\.)"
    devanagari = rf"(?<=(?:{'|'.join(DEVANAGARI)})\.)"
    follows = rf"(?!\s+(?:[\p{{Lu}}\p{{Lo}}“\"«„(\[<\\]|(?:{'|'.join(STARTERS)})\b))"
    ending = rf"(?<=(?<![A-Za-z])(?:{'|'.join(ENDING)}|[ap]\.m|[ap]\.{_BLANK}m|т\.{_BLANK}?[дп])\.){follows}"
    states = rf"(?<=(?<![A-Za-z])U\.{_BLANK}?S\.)(?:(?=\s+Pat)|{follows})"
    initial = rf"(?<=(?<![\p{{L}}\p{{N}}°])[A-Za-zÀ-ÿА-Яа-яЁё]\.)(?<!(?<!\p{{L}})\d{_BLANK}{{0,2}}[a-zа-я]\.)(?<!(?:[ap]\.{_BLANK}?m|U\.{_BLANK}?S|т\.{_BLANK}?[дп])\.)"
    number = rf"(?<=(?:\A\s{{0,9}}|\n{_BLANK}{{0,9}}\n\s{{0,9}})\d{{1,4}}\.)"
    date = rf"(?<=\d\.)(?=\s+(?:{'|'.join(MONTHS)})\b)"
    parts = r"(?<=(?<!\p{L})[ap]\.)(?=m\.)|(?<=(?<!\p{L})\p{L}\.)(?=\p{Ll}\.)"
    alone = rf"(?![.{_TERMINATORS}])(?:{'|'.join([latin, cyrillic, devanagari, ending, states, initial, number, date, parts])}|(?<=[฀-๿]\.))"
    return F.regexp_replace(text, rf"\.(?:(?<=\d\.)(?=\d)|(?=[,;:%º°\-‐‑–/=_]|[A-Za-z0-9_-]{{2,}}\.(?:com|org|net|example|test)\b)|{alone})", STOP)


def _set_marks(text: Column) -> Column:
    closing = r"(?:[”’»\)\]」』）】]|[^\S\n]»(?=[\s.,;:)]|\z)|\"|[“«](?=\s|\z))*"
    thai = r"[ \u00a0\t]+(?=[\u0e00-\u0e7f])(?<=[\u0e00-\u0e7f][ \u00a0\t]{1,9})"
    ends = rf"[\p{{P}}&&[.{_TERMINATORS}]]+{closing}|\n(?={_BLANK}*\n)"
    return _let(text, lambda t: F.when(t.rlike("[\u0e00-\u0e7f]"), F.regexp_replace(t, f"{ends}|{thai}", f"$0{MARK}")).otherwise(F.regexp_replace(t, ends, f"$0{MARK}")))


def sentence_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, unit, start_at, text``: the units of every document in order, with their places."""
    clean = F.regexp_replace(F.col(text_col), "[\ue000-\ue0ff]", "\ufffd")
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    lengths = lambda c: F.transform(c, F.length)

    def chunks(p: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, CHUNK))
        return _let(cut, lambda cs: F.struct(cs.alias("chunks"), F.transform(cs, lambda c: total(lengths(c))).alias("sums")))

    whole = _let(F.split(_set_marks(_masked_stops(_inner_quotes(_addresses(clean)))), MARK), chunks)
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.array(whole)).alias("w"))
    rows = rows.select("id", F.col("w.sums").alias("sums"), F.posexplode("w.chunks").alias("n", "c"))
    rows = rows.select("id", "n", F.explode(F.array(F.struct("c", total(F.slice("sums", 1, F.col("n"))).alias("base"), lengths(F.col("c")).alias("lengths")))).alias("y")).select("id", "n", "y.*")
    units = F.transform("c", lambda x, i: F.struct(x.alias("x"), (F.col("base") + total(F.slice("lengths", 1, i))).alias("at")))
    rows = rows.select("id", "n", F.posexplode(units).alias("i", "u"))
    trimmed = F.ltrim("u.x", F.lit(_SPACE))
    rows = rows.select("id", (F.col("n") * CHUNK + F.col("i")).alias("unit"), "u.x", "u.at", trimmed.alias("t")).where("t <> ''")
    restored = F.translate(F.rtrim("t", F.lit(_SPACE)), _MASKS + "".join(p + q for _, _, p, q in _QUOTES), _MARKED + "".join(a + z for a, z, _, _ in _QUOTES))
    return rows.select(F.col("id").alias(id_col), "unit", (F.col("at") + F.length("x") - F.length("t")).alias("start_at"), restored.alias("text"))
