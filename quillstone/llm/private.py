"""Personal information in free text by information-theoretic sanitisation.

Entities of fixed form - e-mail addresses, phone numbers, identity numbers, street and post-box addresses - are found by shape,
by the word before them and by check digits. Names have no form, so the corpus tells which terms reveal one. A term is a word or the last four
letters of words; its disclosure is the log-ratio, in bits, of the chance that a text holding it holds it in a
protected place (a mailbox name, after a personal title) to that chance over all terms. Terms above
``DISCLOSURE_BITS`` that occur in enough texts reveal: words are given names, endings are those of surnames. A second
count takes the frames (the words around) of names found so; words that frames of high disclosure enclose, in any
script, are given names too. A revealing term with its neighbours (initial, particle, surname) is a name and is removed.

All counts cover every text, and the support that a term needs is the same at every size. Up to ``BROADCAST_TERMS``
revealing terms are sent to every executor; more are joined with the words of each text.

Defined results: null ids and contents are left out; an id in several rows gives the kinds of all its rows; empty texts
hold nothing; text outside the placeholders stays as it is; overlapping findings go to the first in the order of ``KINDS``,
then the leftmost; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.scratch import Scratch

KINDS = ("email", "address", "phone", "id_number", "name")
#: Bits of disclosure above which a term reveals; number of protected places that it must have.
DISCLOSURE_BITS, LEAST = 7.0, 3
#: Revealing terms up to this number are broadcast.
BROADCAST_TERMS = 100_000
#: Different protected words that an ending of surnames must have.
ENDING_WORDS = 5
#: A term that is protected in this share of its texts reveals whatever the share of all terms.
MOSTLY = 0.3

_S, _D = r"(?:\s{1,3})", r"(?:[\s.\-‐‑–]{1,3})"
EMAIL = re.compile(r"(?:mailto:)?[\w.+\-]*\w(?:@|\s?[(\[]at[)\]]\s?)[\w\-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?)[\w\-]+)*(?:\.|\s?[(\[]dot[)\]]\s?)[a-z]{2,}", re.I)
PHONE = re.compile(
    rf"(?:tel:)?(?<![\w+.])\+\d{{1,3}}(?:{_S}?\(0\))?(?:{_D}?\d){{7,11}}(?!\d)"
    r"|(?<![\w.+/#-])00[1-9]\d{9,12}(?!\w)"
    rf"|(?<![\w)])\(\d{{3}}\){_S}?\d{{3}}{_D}\d{{4}}(?!\w)"
    r"|(?<![\w.+/#-])(?:1[-.\s‑])?\d{3}([-.‐‑])\d{3}\1\d{4}(?![\w-])(?:\s{1,3}ext\.?\s{0,3}\d{1,5})?"
    rf"|(?<![\w.+/#-])0\d{{4}}{_S}\d{{3}}{_S}\d{{3}}(?!\w)"
    rf"|(?<![\w.+/#-])0\d(?:{_S}\d\d){{4}}(?!\w)"
    rf"|(?<![\w.+/#-])\(?0[1-9]\d{{1,2}}\)?{_S}\d{{3,4}}{_S}\d{{4}}(?!\w)",
    re.I,
)
#: A number after a word for telephones, in any grouping; dates are none.
PHONE_CUE = re.compile(rf"\b(?:tel|phone|telephone|mobile|cell|fax|telefon|tél|teléfono){_S}?[.:]?{_S}?(?!(?:19|20)\d\d-\d\d-\d\d(?!\d))\(?\d{{1,4}}\)?(?:[\s.\-/]{{1,2}}\d{{2,5}}){{1,4}}(?![\w-])", re.I)
PHONE_WORDS = ("tel", "phone", "mobile", "cell", "fax", "tél")
ID_NUMBER = re.compile(
    rf"(?:\bSSN{_S})?(?<![\w.#/-])\d{{3}}-\d\d-\d{{4}}(?![\w-])|\bSSN:?{_S}\d{{3}}[\s-]\d\d[\s-]\d{{4}}(?!\w)"
    rf"|\b(?:national{_S}id:?{_S})\d{{4}}{_S}?\d{{4}}{_S}?\d{{4}}(?!\w)"
    rf"|\b(?:driver'?s?{_S}licen[cs]e:?{_S})[A-Z]\d{{3}}-\d{{4}}-\d{{4}}(?!\w)"
    rf"|\b(?:personal{_S}number:?{_S})\d{{6}}-\d{{4}}(?!\w)"
    rf"|\b(?:tax{_S}id:?{_S})\d\d-\d{{7}}(?!\w)"
    rf"|(?<![\w.#/-])ZZ\d{{7}}(?!\w)|\bQQ(?:{_S}?\d\d){{3}}{_S}?[A-D]\b"
    rf"|\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?:{_S}\d\d){{3}}{_S}[A-D]\b",
    re.I,
)
#: A number after a word for documents and registers: groups of letters and digits that each hold a digit.
ID_CUE = re.compile(
    rf"\bpassport(?:{_S}(?:no\.?|number|nr\.?))?:?{_S}(?=(?:[A-Z]{{0,2}}\d+[A-Z]{{0,2}})+(?!\w))(?=\w*\d\w*\d\w*\d\w*\d)[A-Z0-9]{{6,9}}(?!\w)"
    rf"|\b(?:aadhaar|personnummer|cpf|dni|nif|codice{_S}fiscale|steuer-?id|social{_S}insurance|nino|national{_S}insurance)(?:{_S}(?:no\.?|number))?:?{_S}(?=[A-Z0-9.\s-]{{7}})[A-Z]{{0,6}}\d[A-Z0-9]*(?:[\s.\-](?=[A-Z]{{0,2}}\d)[A-Z0-9]+){{0,4}}(?!\w)",
    re.I,
)
ID_WORDS = ("passport", "aadhaar", "personnummer", "cpf", "dni", "nif", "fiscale", "steuer", "insurance", "nino")
#: An account number: two letters, two check digits and groups; the check digits must hold.
IBAN = re.compile(rf"(?<![\w.#/-])[A-Z]{{2}}\d\d(?:{_S}?[A-Z0-9]{{4}}){{2,7}}(?:{_S}?[A-Z0-9]{{1,3}})?(?!\w)")
_TOWN = rf",{_S}(?:\d{{4,6}}{_S})?[^\W\d_]+(?:{_S}(?:[A-Z]{{1,2}}\d{{1,2}}{_S}\d[A-Z]{{2}}|\d{{5}})\b)?"
#: Each form of an address, and what a text that holds one must contain.
ADDRESS = [
    (("street", "lane", "road", "rd", "ave", "court", "drive", "boulevard", "blvd", "way", "square", "place", "crescent", "close", "terrace", "gardens", "grove", "mews", "parade"), re.compile(
        rf"(?:\b(?:unit|flat|apt\.?|suite){_S}\w{{1,4}},{_S})?(?<![\w.-])\d{{1,5}}[A-Z]?(?:-\d{{1,4}})?{_S}[^\W\d_]+{_S}(?:street|lane|road|rd|ave|avenue|court|drive|boulevard|blvd|way|square|place|crescent|close(?=,)|terrace|gardens|grove|mews|parade)\b\.?"
        rf"(?:,{_S}(?:apt|unit|suite|flat)\.?{_S}\w{{1,4}})?(?:{_TOWN}|\s{{1,3}}[^\W\d_]+{_S}[A-Z]{{1,2}}\d{{1,2}}{_S}\d[A-Z]{{2}}\b)?", re.I)),
    (("rue", "avenue", "boulevard", "place"), re.compile(rf"(?<![\w.-])\d{{1,5}}{_S}(?:rue|avenue|boulevard|place){_S}(?:de{_S}|du{_S}|des{_S})?[^\W\d_]+(?:{_TOWN})?", re.I)),
    (("strasse", "straße"), re.compile(rf"\b[^\W\d_]+(?:strasse|straße){_S}\d{{1,5}}(?!\w)(?:{_TOWN})?", re.I)),
    (("via", "viale", "piazza", "corso", "rua", "ulica", "ul."), re.compile(rf"\b(?:via|viale|piazza|corso|rua|ulica|ul\.){_S}(?-i:[A-Z\u00c0-\u00de])[^\W\d_]*(?:{_S}[^\W\d_]+){{0,2}},?{_S}\d{{1,5}}[a-z]?(?!\w),{_S}(?:\d{{4,6}}{_S})?(?-i:[A-Z\u00c0-\u00de])[^\W\d_]+", re.I)),
    (("calle",), re.compile(rf"\bcalle{_S}[^\W\d_]+{_S}\d{{1,5}}(?!\w)(?:,{_S}\d{{1,2}}[º°ª]?{_S}[A-Z]\b)?(?:{_TOWN})?", re.I)),
    (("box",), re.compile(rf"\bP\.?\s?O\.?{_S}?Box{_S}\d{{1,6}}(?!\w)(?:{_TOWN})?", re.I)),
]
_PHONE_HINT, _ID_HINT = re.compile(r"\+\d|\b0\d|\d{3}[-.‐‑–)]"), re.compile(r"\d\d-\d|\d\d [a-d]\b|ssn|national|licen|personal|passport|zz\d|tax|qq")
_IBAN_HINT = re.compile(r"[A-Z]{2}\d\d[ A-Z\d]")
_MAILBOX = re.compile(r"([\w.+\-]*\w)\s?(?:@|[(\[]at[)\]])", re.I)
_TITLE = re.compile(r"\b(?:mrs|mr|ms|miss|prof\.?|dr\.)\.?\s{1,3}([^\W\d_]+)", re.I)
_BEFORE = re.compile(r"\b(?:(?:mrs|mr|ms|miss|prof)\.?|dr\.|[^\W\d_]\.)\s{1,3}([^\W\d_]+)")
_TITLED = re.compile(r"\b(?:mrs|mr|ms|miss|prof|dr)\.?\s{1,3}$")
#: Two capitalised words of an alphabet with letter case.
_CAPITALS = re.compile(r"(?<!\w)([A-Z\u00c0-\u00de\u0370-\u042f][^\W\d_]{2,})\s([A-Z\u00c0-\u00de\u0370-\u042f][^\W\d_]{2,})(?=[^\w\n]{1,3}(\w+))")
_LEFT = re.compile(r"(\w+)[^\w\n]{1,3}$")
_WORD = re.compile(r"[^\W\d_]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def _decoded(text: str) -> tuple[str, list[int] | None]:
    """Text with JSON's ``\\uXXXX`` read, and where each character began; None if nothing was escaped."""
    if "\\u" not in text:
        return text, None
    out, at, last = [], [], 0
    for m in _ESCAPE.finditer(text):
        out.append(text[last : m.start()])
        at.extend(range(last, m.start()))
        out.append(chr(int(m[1], 16)))
        at.append(m.start())
        last = m.end()
    out.append(text[last:])
    at.extend(range(last, len(text) + 1))
    return "".join(out), at


def _checks(account: str) -> bool:
    """Whether the check digits of an account number hold: the remainder by 97 of its letters and digits is 1."""
    plain = "".join(account.split()).upper()
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _formed(text: str) -> list[tuple[int, int, str]]:
    """Entities of fixed form; what is found is blanked before the next kind is looked for."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()

    def take(kind: str, pattern: re.Pattern) -> None:
        nonlocal text
        for m in list(pattern.finditer(text)):
            found.append((m.start(), m.end(), kind))
            text = text[: m.start()] + "\x00" * (m.end() - m.start()) + text[m.end() :]

    if "@" in low or "at)" in low or "at]" in low:
        take("email", EMAIL)
    for hints, pattern in ADDRESS:
        if any(h in low for h in hints):
            take("address", pattern)
    if _IBAN_HINT.search(text):
        for m in list(IBAN.finditer(text)):
            if _checks(m[0]):
                found.append((m.start(), m.end(), "id_number"))
                text = text[: m.start()] + "\x00" * (m.end() - m.start()) + text[m.end() :]
    if any(w in low for w in ID_WORDS):
        take("id_number", ID_CUE)
    if _PHONE_HINT.search(low):
        take("phone", PHONE)
    if _ID_HINT.search(low):
        take("id_number", ID_NUMBER)
    if any(w in low for w in PHONE_WORDS):
        take("phone", PHONE_CUE)
    return found


def _evidence(text: str) -> tuple[set[str], set[str]]:
    """Words of the text, and those in protected places."""
    low = text.lower()
    inside: set[str] = set()
    if "@" in low or "at)" in low or "at]" in low:
        for m in _MAILBOX.finditer(low):
            inside.update(_WORD.findall(m[1]))
    inside.update(m[1] for m in _TITLE.finditer(low))
    return {*_WORD.findall(low)}, {w for w in inside if len(w) > 2}


def _counted(n: Counter, k: Counter) -> Iterator[pd.DataFrame]:
    terms = list(n)
    for s in range(0, len(terms), 50_000):
        some = terms[s : s + 50_000]
        yield pd.DataFrame({"term": pd.Series(some, dtype=object), "n": [n[x] for x in some], "k": [k[x] for x in some]})


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, k = Counter(), Counter()
    for b in batches:
        for t in b["content"]:
            every, inside = _evidence(_decoded(t)[0])
            n.update(every)
            k.update(inside)
        if len(n) > 400_000:
            yield from _counted(n, k)
            n, k = Counter(), Counter()
    yield from _counted(n, k)


class Names:
    """Finds names by revealing words and endings."""

    def __init__(self, given: set[str], endings: set[str]) -> None:
        self.given, self.endings = given, endings

    def surname(self, word: str) -> bool:
        return len(word) > 4 and word[-4:] in self.endings and word not in self.given

    def find(self, text: str) -> list[tuple[int, int]]:
        """Given names with a surname, and surnames after a title or an initial."""
        low, out, done = text.lower(), [], 0
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if self.given.isdisjoint(_WORD.findall(low)):
            return [m.span() for m in _BEFORE.finditer(low) if self.surname(m[1])]
        tokens = [(m.start(), m.end(), low[m.start() : m.end()]) for m in _WORD.finditer(text)]
        for i, (a, z, w) in enumerate(tokens):
            if a < done:
                continue
            if w in self.given:
                start, end = a, self._surname_after(text, tokens, i)
                if not end and i and self.surname(tokens[i - 1][2]) and tokens[i - 1][0] >= done and re.fullmatch(r",\s{1,3}", text[tokens[i - 1][1] : a]):
                    start, end = tokens[i - 1][0], z
                if end:
                    m = _TITLED.search(low[max(done, start - 8) : start])
                    out.append((start - len(m[0]) if m else start, end))
                    done = end
            elif self.surname(w) and (m := _BEFORE.search(low[max(done, a - 8) : z])) and m[1] == w:
                out.append((z - len(m[0]), z))
                done = z
        return out

    def _surname_after(self, text: str, tokens: list, i: int) -> int:
        """End of the surname that follows token ``i``, over an initial or particles; 0 without one."""
        script, j, at = ord(tokens[i][2][0]) > 0x24F, i + 1, tokens[i][1]
        while j < len(tokens) and j <= i + 4:
            b, y, w = tokens[j]
            if not re.fullmatch(r"\.?\s{1,3}" if j > i + 1 and len(tokens[j - 1][2]) == 1 else r"\s{1,3}", text[at:b]):
                return 0
            if len(w) == 1 or w in ("de", "la", "van", "von", "der", "del", "di", "da", "bin", "al"):
                at, j = y, j + 1
                continue
            if not (self.surname(w) or (script and ord(w[0]) > 0x24F)):
                return 0
            while j + 1 < len(tokens) and text[y : tokens[j + 1][0]] in ("-", "‐", "‑") and self.surname(tokens[j + 1][2]):
                j, y = j + 1, tokens[j + 1][1]
            return y
        return 0


def _frames(names_of: Callable) -> Callable:
    """Counts of frames around two capitalised words, with the first word where it is not known as given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = Counter()
        for b in batches:
            for t, names in zip(b["content"], names_of(b), strict=False):
                t = _decoded(t)[0]
                if t.isupper():
                    continue
                for m in _CAPITALS.finditer(t):
                    left = _LEFT.search(t[max(0, m.start() - 30) : m.start()])
                    known = m[1].lower() in names.given and names.surname(m[2].lower())
                    foreign = ord(m[1][0]) >= 0x370 and ord(m[2][0]) >= 0x370
                    out[(left[1].lower() if left else "", m[3].lower(), "" if known else m[1].lower() if foreign else "*")] += 1
        if out:
            yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["left", "right", "word", "n"]).astype({"left": object, "right": object, "word": object})

    return run


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every word that ``Names`` may look up in a text, lower-cased in each of the ways that it does."""
    for b in batches:
        h, w = [], []
        for x, t in zip(b["h"], b["content"], strict=True):
            t = _decoded(t)[0]
            low = t.lower()
            own = {*_WORD.findall(low), *_WORD.findall("".join(c.lower() if len(c.lower()) == 1 else c for c in t))}
            own |= {m.lower() for m in _WORD.findall(t)}
            h += [x] * len(own)
            w += own
        yield pd.DataFrame({"h": pd.Series(h, dtype=object), "word": pd.Series(w, dtype=object)})


def _with_terms(rows: DataFrame, terms: DataFrame, scratch: Scratch) -> tuple[DataFrame, Callable]:
    """``rows``, with ``given, endings`` where the terms are too many to broadcast, and a function from a batch to its texts' ``Names``."""
    if terms.count() <= BROADCAST_TERMS:
        found = terms.collect()
        shared = rows.sparkSession.sparkContext.broadcast(({r["term"] for r in found if not r["ending"]}, {r["term"] for r in found if r["ending"]}))
        return rows, lambda b: repeat(Names(*shared.value))
    hashed = rows.withColumn("h", F.sha2("content", 256))
    words = hashed.select("h", "content").mapInPandas(_words, "h string, word string").distinct()
    keys = words.select("h", F.explode(F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("ending")), F.struct(F.expr("right(word, 4)").alias("term"), F.lit(True).alias("ending")))).alias("x")).select("h", "x.*")
    own = keys.join(terms, ["term", "ending"]).groupBy("h").agg(F.collect_set(F.when(~F.col("ending"), F.col("term"))).alias("given"), F.collect_set(F.when(F.col("ending"), F.col("term"))).alias("endings"))
    own = scratch.cut(own, "own_terms")
    none = F.array().cast("array<string>")
    out = hashed.join(own, "h", "left").select(*rows.columns, F.coalesce("given", none).alias("given"), F.coalesce("endings", none).alias("endings"))
    return out, lambda b: (Names(set(g), set(e)) for g, e in zip(b["given"], b["endings"], strict=True))


def learn(records: DataFrame, scratch: Scratch, content_col: str = "content") -> DataFrame:
    """``term, ending``: given names and surname endings that the corpus reveals."""
    rows = records.select(F.col(content_col).alias("content")).where("content is not null")
    counted = rows.mapInPandas(_terms, "term string, n bigint, k bigint").groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counted = scratch.cut(counted, "terms")
    k, n = counted.agg(F.sum("k"), F.sum("n")).first()
    if not k:
        return records.sparkSession.createDataFrame([], "term string, ending boolean")
    reveals = (F.log2(F.col("k") / F.col("n") / F.lit(k / n)) >= DISCLOSURE_BITS) | (F.col("k") / F.col("n") >= MOSTLY)
    ends = counted.where("length(term) > 5").groupBy(F.expr("right(term, 4)").alias("term")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 0).alias("words"))
    endings = scratch.cut(ends.where((F.col("k") >= LEAST) & (F.col("words") >= ENDING_WORDS) & reveals).select("term"), "endings")
    given = counted.where((F.col("k") >= LEAST) & reveals).select("term")
    given = given.join(endings.select(F.col("term").alias("e")), F.expr("right(term, 4)") == F.col("e"), "left_anti")
    terms = scratch.cut(given.select("term", F.lit(False).alias("ending")).unionByName(endings.select("term", F.lit(True).alias("ending"))), "revealing")
    # frames: of a left and a right word, how often they enclose a name found so, and other words that they enclose
    framed, names_of = _with_terms(rows, terms, scratch)
    frame = framed.mapInPandas(_frames(names_of), "left string, right string, word string, n bigint").groupBy("left", "right", "word").agg(F.sum("n").alias("n"))
    sides = frame.select(F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"))).alias("side"), "word", "n")
    good = sides.groupBy("side").agg(F.sum(F.when(F.col("word") == "", F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("n"))
    good = good.where((F.col("known") >= LEAST) & (F.col("known") / F.col("n") >= 0.3)).select("side")
    more = sides.where("word <> '' and word <> '*'").join(good, "side").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)
    return scratch.cut(terms.unionByName(more.select(F.col("word").alias("term"), F.lit(False).alias("ending"))).distinct(), "learned")


def find(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Start, end and kind of every finding, in order and without overlaps."""
    read, at = _decoded(text)
    found = _formed(read)
    rest = read
    for a, z, _ in found:
        rest = rest[:a] + "\x00" * (z - a) + rest[z:]
    found += [(a, z, "name") for a, z in names.find(rest)]
    found.sort()
    return [(at[a], at[z], k) for a, z, k in found] if at else found


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """Text with every finding replaced by its kind in brackets."""
    out, last = [], 0
    for a, z, kind in found:
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
            last = z
    return "".join([*out, text[last:]])


def _scan(names_of: Callable) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t, names) for t, names in zip(b["content"], names_of(b), strict=False)]
            yield pd.DataFrame({"id": b["id"], "clean": [redact(t, f) if f else t for t, f in zip(b["content"], found, strict=True)], "kinds": [sorted({k for _, _, k in f}) for f in found]})

    return run


def sanitise(records: DataFrame, scratch: Scratch, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """``id, clean, kinds``: every row's text with typed placeholders, and the kinds found in it."""
    rows = records.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).where("id is not null and content is not null")
    named, names_of = _with_terms(rows, learn(records, scratch, content_col), scratch)
    return named.mapInPandas(_scan(names_of), "id string, clean string, kinds array<string>")
