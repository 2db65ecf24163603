"""Tokens as a full-text index makes them: unicode letters and digits without diacritics, Porter stems."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = frozenset("aeiou")
#: Porter's rules (1980): suffix, replacement. Fixed values of the algorithm.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
    "iti", "ous", "ive", "ize",
]


def _shape(word: str) -> str:
    """word as c and v: y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in _VOWELS or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in _VOWELS


def _closed(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """The Porter stem of a lower-case word; words outside a-z, of under 3 or over 64 bytes stay."""
    if not word.isascii() or not 3 <= len(word) <= 64 or not word.isalnum():
        return word
    if (word.endswith("sses") and len(word) > 4) or (word.endswith("ies") and len(word) > 3):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                stem = word[: -len(suffix)]
                if _has_vowel(stem):
                    word = stem
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif _doubled(word) and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _closed(word):
                        word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(word, STEP_2, 0)
    word = _replace(word, STEP_3, 0)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _closed(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def fold_diacritics(text: str) -> str:
    """Lower case without combining marks."""
    decomposed = unicodedata.normalize("NFD", text.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


def index_tokens(text: str | None) -> list[str]:
    """Stems of the letter and digit runs of a text, in order."""
    return [porter(t) for t in re.findall(r"[^\W_]+", fold_diacritics(text or ""))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_tokens(text: pd.Series) -> pd.Series:
    """index_tokens() of each text; null has none."""
    return text.map(index_tokens, na_action=None)


def question_words(text: str | None, stop: frozenset[str]) -> list[str]:
    """Distinct stems of a question's content words: no stop words and no single letters, sorted."""
    words = [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if len(w) > 1 and w not in stop]
    return sorted({porter(w) for w in map(fold_diacritics, words)})


def question_stems(text: str, stop: frozenset[str]) -> Column:
    """question_words() of a column."""
    return F.pandas_udf(lambda t: t.map(lambda x: question_words(x, stop), na_action=None), T.ArrayType(T.StringType()))(text)


def stemmed_again(term: str) -> Column:
    """A stem as a query sends it: the index's tokenizer stems the terms of a query once more."""
    return F.pandas_udf(lambda t: t.map(porter), T.StringType())(term)
