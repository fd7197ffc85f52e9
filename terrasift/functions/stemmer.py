"""Porter's stemming algorithm (M. F. Porter, 1980), for distinct terms in a pandas UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

# The suffix rules of the published algorithm, longest first within a step.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c and v for each letter."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """Words of one or two letters stay as they are."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            base = word[: -len(end)]
            if word.endswith(end) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    word = base + "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                    word = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    word = base + "e"
                else:
                    word = base
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        hits = [(a, b) for a, b in rules if word.endswith(a)]
        if hits:
            a, b = max(hits, key=lambda r: len(r[0]))
            if _measure(word[: -len(a)]) > 0:
                word = word[: -len(a)] + b
    hits = [a for a in _STEP4 if word.endswith(a)]
    if hits:
        a = max(hits, key=len)
        cut = 3 if a in ("sion", "tion") else len(a)
        if _measure(word[:-cut]) > 1:
            word = word[:-cut]
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_column(words):
    """The stems of a column of words."""
    @F.pandas_udf("string")
    def stems(w: pd.Series) -> pd.Series:
        return w.map(lambda x: None if x is None else stem(x))

    return stems(words)
