"""Suffix stripping after Porter's paper of 1980, applied to distinct terms only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# The suffix rules of the paper's steps 2, 3 and 4.
STEP2 = (
    "ational ate, tional tion, enci ence, anci ance, izer ize, abli able, alli al, entli ent, eli e, ousli ous, ization ize, "
    "ation ate, ator ate, alism al, iveness ive, fulness ful, ousness ous, aliti al, iviti ive, biliti ble"
)
STEP3 = "icate ic, ative , alize al, iciti ic, ical ic, ful , ness "
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _rules(text: str) -> list[tuple[str, str]]:
    pairs = [(p + " ").split(" ")[:2] for p in text.split(", ")]
    return sorted(((a, b) for a, b in pairs), key=lambda r: -len(r[0]))


_STEP2, _STEP3, _STEP4 = _rules(STEP2), _rules(STEP3), sorted(STEP4, key=len, reverse=True)


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(word):
        out.append(c not in "aeiou" and not (c == "y" and i > 0 and out[-1]))
    return out


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    k = _consonants(stem)
    return sum(1 for a, b in zip(k, k[1:], strict=False) if not a and b)


def _has_vowel(stem: str) -> bool:
    return not all(_consonants(stem))


def _ends_cvc(word: str) -> bool:
    k = _consonants(word)
    return len(word) > 2 and k[-3] and not k[-2] and k[-1] and word[-1] not in "wxy"


def _double_consonant(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _replace(word: str, rules: list[tuple[str, str]]) -> str:
    for suffix, to in rules:  # the longest matching suffix decides
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + to if _measure(stem) > 0 else word
    return word


def porter(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_consonant(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _ends_cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(word[:-1])):
            word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def stem_terms(terms: DataFrame, column: str = "term") -> DataFrame:
    """``(term, stem)`` of the distinct terms; the vocabulary, not the tokens, passes through Python."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"term": b["term"], "stem": [porter(t) for t in b["term"]]})

    return terms.where(terms[column].isNotNull()).select(terms[column].alias("term")).distinct().mapInPandas(run, "term string, stem string")
