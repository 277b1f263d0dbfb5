"""Tokens for search: ASCII-folded words, optionally Porter stems, and character trigrams."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import ascii_lower

NOT_WORD = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Tokens of an `ascii` tokenizer: letters A-Z folded, everything from U+0080 on belongs to words."""
    return F.filter(F.split(ascii_lower(text), NOT_WORD), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """All three-character pieces of a text, without regard to case."""
    low = F.lower(text)
    n = F.char_length(low)
    pieces = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(n >= 3, pieces).otherwise(F.array().cast("array<string>"))


_VOWEL_RUN = re.compile("[aeiouy]")


def _form(stem: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or (letter == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _form(stem)))


def _short_end(stem: str) -> bool:
    return _form(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


#: Suffixes of Porter's steps 2, 3 and 4.
STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,bli ble,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble,logi log"
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"
_STEP2 = [x.split(" ") for x in STEP2.split(",")]
_STEP3 = [x.split(" ") for x in STEP3.split(",")]
_STEP4 = sorted([*STEP4.split(), "ion"], key=len, reverse=True)


def stem(word: str) -> str:
    """Porter's stem of a lower-case ASCII word; others stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        base = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in _form(word[: -len(x)])), None)
        if base is not None:
            word = base
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word[-2:-1] == word[-1:] and _form(word)[-1:] == "c" and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for old, new in sorted(table, key=lambda p: -len(p[0])):
            if word.endswith(old):
                if _measure(word[: -len(old)]) > 0:
                    word = word[: -len(old)] + new
                break
    for old in _STEP4:
        if word.endswith(old):
            base = word[: -len(old)]
            if _measure(base) > 1 and (old != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(StringType())
def porter(word: pd.Series) -> pd.Series:
    """Stems of a column of tokens; each distinct token of a batch is stemmed once."""
    return word.map({w: stem(w) for w in word.dropna().unique()})
