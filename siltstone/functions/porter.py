"""Word analysis for full-text search: alphanumeric words without diacritics, reduced by Porter's 1980 algorithm."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: ASCII in lower case, with blanks for what is in no word.
_SPACED = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else 32 for c in range(256))
#: Suffix rules of steps 2, 3 and 4 in Porter's paper.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_R2, _R3 = ([tuple(x.split(":")) for x in sorted(s.split(), key=lambda x: -len(x.split(":")[0]))] for s in (STEP2, STEP3))
_R4 = sorted(STEP4.split(), key=len, reverse=True)


def _shape(w: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """Words of other letters than a to z, and of fewer than three or more than 64, stay as they are."""
    if not 3 <= len(w) <= 64 or not w.isascii() or not w.isalpha():
        return w
    # 1a: plurals
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: past and progressive
    if w.endswith("eed"):
        if _measure(w[:-3]):
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_R2, _R3):
        for end, new in rules:
            if w.endswith(end):
                if _measure(w[: -len(end)]):
                    w = w[: -len(end)] + new
                break
    for end in _R4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(text: str) -> str:
    text = unicodedata.normalize("NFD", text.lower())
    for c in set(text):
        if c > "\x7f" and unicodedata.combining(c):
            text = text.replace(c, "")
    return text


def words(text: str | None) -> list[str]:
    """The words before they are stemmed."""
    if not text:
        return []
    text = text if text.isascii() else fold(text)
    return text.encode().translate(_SPACED).decode().split() if text.isascii() else _WORD.findall(text)


def analyse(text: str | None, stemmed: bool = True) -> list[str]:
    own = words(text)
    return [stem(w) for w in own] if stemmed else own


def analyse_column(c: Column | str) -> Column:
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: analyse(t) if isinstance(t, str) else [])

    return F.pandas_udf(run, "array<string>")(c)
