"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), as published, over distinct terms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Suffixes and what replaces them, tried in this order; the longest match of a step decides.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
RUNS = re.compile("v+c+")


def shape(stem: str) -> str:
    """Each letter as v or c; y after a consonant is a vowel."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    return len(RUNS.findall(shape(stem)))


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word).endswith("c")


def short(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def swapped(word: str, table: list[tuple[str, str]], least: int) -> str:
    """The longest suffix of the table decides; it is replaced where the stem's measure is above `least`."""
    for old, new in sorted(table, key=lambda t: -len(t[0])):
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if measure(stem) > least else word
    return word


@lru_cache(100_000)
def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: len(word) - len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(e)] for e in ("ed", "ing") if word.endswith(e) and "v" in shape(word[: -len(e)])), None)
        if cut is not None:
            word = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if doubled(cut) and cut[-1] not in "lsz" else cut + "e" if measure(cut) == 1 and short(cut) else cut
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = swapped(swapped(word, STEP2, 0), STEP3, 0)
    end = next((e for e in sorted(STEP4, key=len, reverse=True) if word.endswith(e)), None)
    if end:
        stem = word[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
        if measure(stem) > 1:
            word = stem
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


@F.pandas_udf(ArrayType(StringType()))
def porter_all(terms: pd.Series) -> pd.Series:
    """Stems of each array of terms."""
    return terms.map(lambda t: None if t is None else [porter(w) for w in t])
