"""Porter's stemmer (1980) for search tokens: an Arrow function with a cache, as the steps have no expression form."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shape(stem: str) -> str:
    """One letter for each of ``stem``: v for a vowel, c for a consonant (y after a consonant is a vowel)."""
    out = ""
    for i, ch in enumerate(stem):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of steps 2, 3 and 4.
_STEP2 = "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble"
_STEP3 = "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _replace(w: str, table: str, least: int) -> str:
    for rule in sorted(table.split(), key=lambda r: -len(r.split(">")[0])):
        old, _, new = rule.partition(">")
        if w.endswith(old):
            stem = w[: len(w) - len(old)]
            return stem + new if _measure(stem) > least else w
    return w


@functools.lru_cache(maxsize=200_000)
def porter(w: str) -> str:
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)) is not None:
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2, 0), _STEP3, 0)
    for s in sorted(_STEP4.split(), key=lambda s: -len(s)):
        if w.endswith(s):
            stem = w[: -len(s)]
            if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and w.endswith("ll") else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: [porter(t) for t in ts] if ts is not None else None)
