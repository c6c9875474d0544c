"""Unicode folding shared by the text operators."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import xxhash


@cache
def _marks() -> re.Pattern:
    """Runs of combining characters."""
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    starts = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    ends = [c for c in marks if c == 0x10FFFF or not unicodedata.combining(chr(c + 1))]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]+")


def without_marks(text: str) -> str:
    """Compatibility decomposition without accents and other combining marks."""
    return text if text.isascii() else _marks().sub("", unicodedata.normalize("NFKD", text))


class WordHashes(dict):
    """Word → 64-bit hash, remembered; emptied when it has grown large, which affects speed only."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        """Hashes of a list of words."""
        if len(self) > self.MOST:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
