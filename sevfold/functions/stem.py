"""Porter stemming (M. F. Porter, "An algorithm for suffix stripping", 1980)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Suffix tables of the published steps 2, 3 and 4.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e "
    "ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous "
    "aliti:al iviti:ive biliti:ble"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _pairs(table: str) -> list[tuple[str, str]]:
    pairs = [tuple(entry.split(":")) for entry in table.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_STEP2, _STEP3 = _pairs(STEP2), _pairs(STEP3)
_STEP4 = sorted(STEP4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """Word as ``c`` and ``v``; ``y`` is a vowel after a consonant."""
    out: list[str] = []
    for ch in word:
        vowel = ch in "aeiou" or (ch == "y" and bool(out) and out[-1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, pairs: list[tuple[str, str]]) -> str:
    for suffix, replacement in pairs:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + replacement if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=1 << 18)
def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]

    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end)), 0)
        if cut and _has_vowel(word[:-cut]):
            word = word[:-cut]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double_consonant(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"

    word = _swap(_swap(word, _STEP2), _STEP3)

    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break

    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@pandas_udf(ArrayType(StringType()))
def _stem_arrays(tokens: pd.Series) -> pd.Series:
    flat = pd.Series([w for words in tokens if words is not None for w in words], dtype=object)
    codes, distinct = pd.factorize(flat)
    stems = np.array([porter(w) for w in distinct], dtype=object)
    ends = np.cumsum([0 if words is None else len(words) for words in tokens])
    stemmed = stems[codes] if len(distinct) else stems
    return pd.Series([None if words is None else stemmed[end - len(words) : end] for words, end in zip(tokens, ends)])


def stem_tokens(tokens: Column) -> Column:
    """Stems of an array of words: the distinct words of a batch are stemmed once; no explode, no shuffle."""
    return _stem_arrays(tokens)
