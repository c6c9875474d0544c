import random
import re

import pytest

from codewell.llm.split import cut_spans, split_oversized

BLANK = " \t\r\n"


def brute(t, limit=800, least=400, overlap=100):
    """The rule, word for word."""
    out, s, n = [], 0, len(t)
    while True:
        if n - s <= limit:
            return [*out, (s, n)]
        span = range(s + limit, s + least, -1)
        e = next((e for e in span if t[e - 1] == "\n"), 0)
        e = e or next((e for e in span if t[e - 1] == "。" or (t[e - 2] in ".!?…" and t[e - 1] in BLANK)), 0)
        e = e or next((e for e in span if t[e - 1] in BLANK), s + limit)
        out.append((s, e))
        s = next((p for p in range(e - overlap, e) if t[p] not in BLANK and t[p - 1] in BLANK), e - overlap)


@pytest.mark.parametrize("seed", range(6))
def test_spans_equal_the_rule(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = rng.choice(["ab . \n", "abc", "ab。 ", "ab\t\r ", "a!? …", "ab" * 40 + " .", "xñ😀 　.\n" + "y" * 90])
        t = "".join(rng.choice(letters) for _ in range(rng.choice([801, 900, 1500, 5000])))
        assert cut_spans(t) == brute(t)
        assert cut_spans(t, 30, 12, 5) == brute(t, 30, 12, 5)


def test_cover_and_limits():
    t = re.sub("(.{57})", r"\1 ", "k" * 20_000)
    spans = cut_spans(t)
    assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(b - a <= 800 for a, b in spans)
    assert all(c <= b for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert cut_spans("short") == [(0, 5)] and cut_spans("") == [(0, 0)]
    with pytest.raises(ValueError):
        cut_spans(t, 10, 20, 5)


def test_rows(spark):
    long = "word " * 300
    rows = [(1, 1, long), (1, 1, long), (1, 2, "short"), (2, 3, None), (2, 4, ""), (2, 5, " " * 900), (None, 6, "é" * 801), (3, 7, "x" * 200_000)]
    df = spark.createDataFrame(rows, "document_id int, chunk_id int, text string").selectExpr("*", "1 as piece", "2 as _text")
    got = split_oversized(df, ("document_id", "chunk_id"), "text").collect()
    assert {r.chunk_id for r in got} == {1, 5, 6, 7}
    for k in (1, 5, 7):
        t = next(t for _, c, t in rows if c == k)
        mine = sorted((r.piece_start, r.piece_end) for r in got if r.chunk_id == k)
        assert mine == sorted(brute(t)) and all(t[r.piece_start : r.piece_end] == r.piece for r in got if r.chunk_id == k)
    assert [(r.document_id, r.piece_no) for r in got if r.chunk_id == 6] == [(None, 0), (None, 1)]
    assert split_oversized(df.limit(0), ("document_id", "chunk_id"), "text").count() == 0
