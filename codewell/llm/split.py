"""Splitting oversized texts at natural boundaries with overlapping pieces.

The separators form a hierarchy: section or line break, sentence end, word gap, single character. A piece is packed
greedily up to the limit and cut behind the last separator of the highest level that occurs in the upper half of its span;
the next piece starts in the trailing overlap, at a word start where there is one.

Defined results: NULL, empty and blank texts, and texts within the limit, give no piece; a text without any blank is cut by
characters; repeated rows give their pieces once; extra columns are ignored. Offsets count Unicode code points. The work is
linear in the text, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
#: From the highest level to the lowest; a cut lies directly behind the match.
LEVELS = (re.compile(r"\n"), re.compile(r"[.!?…][ \t\r\n]|。"), re.compile(r"[ \t\r\n]"))
_WORD_START = re.compile(r"(?<=[ \t\r\n])[^ \t\r\n]")


def _last_cut(text: str, low: int, high: int) -> int:
    """Largest cut e with low < e <= high on the highest level that has one; ``high`` if no level has."""
    for level in LEVELS:
        best = 0
        for m in level.finditer(text, max(0, low - 1), high):  # a two-character separator may begin before low
            if m.end() > low:
                best = m.end()
        if best:
            return best
    return high


def cut_spans(text: str, limit: int = 800, least: int = 400, overlap: int = 100) -> list[tuple[int, int]]:
    """Spans of the pieces of one text; a text within the limit is one piece. Needs 0 <= overlap < least < limit."""
    if not 0 <= overlap < least < limit:
        raise ValueError("0 <= overlap < least < limit must hold")
    spans, start, n = [], 0, len(text)
    while n - start > limit:
        end = _last_cut(text, start + least, start + limit)
        spans.append((start, end))
        word = _WORD_START.search(text, max(0, end - overlap), end)
        start = word.start() if word else end - overlap
    spans.append((start, n))
    return spans


def split_oversized(
    df: DataFrame, keys: tuple[str, ...], text: str, limit: int = 800, least: int = 400, overlap: int = 100, with_text: bool = True
) -> DataFrame:
    """``(*keys, piece_no, piece_start, piece_end, piece)`` for every distinct row whose text is longer than the limit; on
    demand without the pieces' texts.

    The length filter runs in the JVM, so only oversized texts reach Python, spread over all tasks; the shuffle of the
    deduplication carries nothing else.
    """
    long = df.select(*keys, F.col(text).alias("_text")).where(F.char_length("_text") > limit).distinct()
    fields = {f.name: f.dataType.simpleString() for f in long.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", piece_no int, piece_start int, piece_end int" + ", piece string" * with_text

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = batch["_text"].tolist()
            spans = [cut_spans(body, limit, least, overlap) for body in bodies]
            row = np.repeat(np.arange(len(batch)), [len(s) for s in spans])
            start, end = np.array([p for s in spans for p in s], np.int64).reshape(-1, 2).T
            out = batch[list(keys)].iloc[row].reset_index(drop=True)
            out["piece_no"] = np.array([i for s in spans for i in range(len(s))], np.int64)
            out["piece_start"], out["piece_end"] = start, end
            if with_text:
                out["piece"] = pd.Series([bodies[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)], dtype=object)
            yield out

    return long.mapInPandas(pieces, schema)
