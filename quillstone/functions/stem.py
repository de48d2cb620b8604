"""English stems by Porter's published algorithm (1980), for columns of tokens.

Stems are computed for the distinct tokens of a batch only and kept from batch to batch.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes of the algorithm's steps 2 to 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_LONGEST = {id(x): sorted(x, key=len, reverse=True) for x in (STEP2, STEP3, STEP4)}


def _shape(word: str) -> str:
    """``v`` for vowels and ``c`` for the rest; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """Number of vowel runs that a consonant follows."""
    return len(re.findall("v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in _LONGEST[id(table)]:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and words that are not of a-z stay."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(rest):
                word = rest
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _shape(word)[-2:] == "cc" and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    for suffix in _LONGEST[id(STEP4)]:
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


class _Known(dict):
    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = stem(word)
        return found


_KNOWN = _Known()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else [_KNOWN[w] for w in t])


def stems(tokens: Column) -> Column:
    """The stems of a column of lower-case tokens."""
    return _stems(tokens)
