"""Words and canonical forms of record texts, shared by the operators on copies and near-copies."""

from __future__ import annotations

import json
import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
#: A labelled field: a label with a letter and without the marks of a sentence, a colon or equals sign, a value.
LABELLED = re.compile(r"([^:=.,!?\n]*[^\W\d_][^:=.,!?\n]*)[:=](.*)", re.S)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFC and lower-casing."""
    text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
    return WORD.findall(text)


def _pairs(found: list) -> list[tuple[str, str]]:
    return [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in found]


def fields(text: str) -> list[tuple[str, str]] | None:
    """Label and value of every field if the whole text is labelled fields or one JSON object, else None.

    Fields are set apart by ``|``, ``;`` or line breaks; a line without a label continues the value above.
    """
    text = text.strip()
    if text[:1] == "{":
        try:
            found = json.loads(text, object_pairs_hook=list)
        except ValueError:
            return None
        return _pairs(found) if isinstance(found, list) and found else None
    if ":" not in text and "=" not in text:
        return None
    for sep in "|;\n":
        if sep not in text:
            continue
        out: list[list[str]] = []
        for part in text.split(sep):
            if not part.strip():
                continue
            if m := LABELLED.match(part):
                out.append([m[1].strip(), m[2].lstrip()])
            elif sep == "\n" and out:
                out[-1][1] += " " + part
            else:
                break
        else:
            if len(out) > 1:
                return [(k, v) for k, v in out]
    return None


def canonical(text: str) -> str:
    """Equal for copies: the word sequence, or the sorted words of the fields of a text of two and more fields."""
    found = fields(text)
    if found is None or len(found) < 2:
        return "\x1d" + " ".join(words(text) if found is None else [w for k, v in found for w in (*words(k), *words(v))])
    return "\x1e".join(sorted(" ".join(words(k)) + "\x1f" + " ".join(words(v)) for k, v in found))
