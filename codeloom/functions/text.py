"""Tokens, phrases and stems for full-text search."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(text: Column) -> Column:
    """Lower case, without diacritics of the Latin letters that have a base letter."""
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), marked, plain)


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")


def spaced(words: Column) -> Column:
    """Tokens as a string in which a phrase can be counted: each between blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def phrase_count(line: Column, phrase: list[str]) -> Column:
    """How often a phrase begins in ``spaced`` tokens; occurrences may overlap."""
    needle = " " + "  ".join(phrase) + " "
    if any(phrase[i:] == phrase[:-i] for i in range(1, len(phrase))):
        return F.regexp_count(line, F.lit(f"(?=\\Q{needle}\\E)")).cast("int")
    return ((F.length(line) - F.length(F.replace(line, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def query_tokens(query: str) -> list[str]:
    marked, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return [t for t in re.split(r"[\W_]+", query.lower().translate(str.maketrans(marked, plain))) if t]


# --- Porter (1980) ------------------------------------------------------------------------------

def _shape(word: str) -> str:
    """A word as c and v: y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


# Suffixes of the published algorithm, by step.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _stem_batch(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}

    def stem(w: str) -> str:
        if w not in known:
            known[w] = porter(w)
        return known[w]

    return words.map(lambda own: None if own is None else [stem(w) for w in own])


def stems(words: Column) -> Column:
    """Porter stems of token arrays, batch by batch."""
    return F.pandas_udf(_stem_batch, "array<string>")(words)
