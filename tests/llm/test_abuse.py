import random

import numpy as np

from codewell.llm.abuse import BUCKETS, WINDOWS, FactorizationMachine, fit_on, score_documents, spans, train, words_of
from codewell.llm.plain import WordHashes

INSULTS = ["grumbler", "snotface", "wretchling", "dungheap", "gutterling"]
GROUPS = ["ostrians", "velkins", "marnites"]


def corpus(n, seed):
    """Insult and group are harmful only together; each alone is ordinary."""
    rng = random.Random(seed)
    filler = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    rows = []
    for k in range(n):
        words = [rng.choice(filler) for _ in range(rng.randint(20, 120))]
        kind = k % 4
        at = rng.randrange(len(words))
        insult, group = rng.choice(INSULTS), rng.choice(GROUPS)
        words[at:at] = {0: ["all", group, "are", insult], 1: ["the", group, "sang", "well"], 2: ["old", insult, "record", "rocks"], 3: []}[kind]
        rows.append((k, " ".join(words), int(kind == 0)))
    return rows


def test_interactions_are_learnt():
    rows, new = corpus(800, 1), corpus(400, 2)
    machine, vocabulary = train([t for _, t, _ in rows], np.array([y for *_, y in rows], float)), WordHashes()
    s = np.array([machine.score(vocabulary.of(words_of(t))) for _, t, _ in new])
    y = np.array([y for *_, y in new])
    hit = ((s >= machine.threshold) == (y == 1)).mean()
    assert hit >= 0.97


def test_prefix_sums_equal_direct_sums():
    rng = np.random.default_rng(0)
    m = FactorizationMachine(-1.0, rng.normal(size=BUCKETS + 1).astype(np.float32), rng.normal(size=(BUCKETS + 1, 8)).astype(np.float32))
    m.w[-1], m.v[-1] = 0, 0
    from codewell.llm.abuse import _padded

    streams = [WordHashes().of([f"x{k}" for k in range(n)]) for n in (1, 0, 2, 5, 6, 7, 16, 17, 90, 0, 3)]
    doc, a, b, raw = m.windows(streams)
    assert np.allclose(raw, m.raw(_padded(streams, doc, a, b)), atol=1e-3)
    for d, stream in enumerate(streams):
        lo, hi = a[doc == d], b[doc == d]
        assert all(any(x <= p < y for x, y in zip(lo, hi, strict=True)) for p in range(len(stream)))
        if len(stream) > WINDOWS[-1][0]:
            assert set(hi - lo) == {w for w, _ in WINDOWS}
        if len(stream):
            assert {(x, y) for x, y in zip(lo, hi, strict=True)} == {(x, y) for x, y in zip(*spans(len(stream)), strict=True)}
    best = [raw[doc == d].max() if (doc == d).any() else -np.inf for d in range(len(streams))]
    assert np.allclose(m.score_all(streams), best) and len(m.score_all([])) == 0
    d, _, _, r = m.foremost(streams, 2)
    assert np.allclose([r[d == k].max() for k in range(len(streams)) if len(streams[k])], [x for x in best if x > -np.inf]) and np.bincount(d).max() == 2
    assert m.score(WordHashes().of([])) == -np.inf and len(spans(3)[0]) == 1


def test_disguises():
    assert words_of("B.R.A.I.N.L.E.S.S p4r4$173$ b i t c h СHОKЕ loooser d*****d cr-tin 1984 don't") == [
        "brainles", "parasites", "bitch", "choke", "loser", "*masked*", "d*d", "crtin", "1984", "dont"]
    assert words_of(None) == words_of(" \n ") == []


def test_rows_and_edge_cases(spark):
    rows = corpus(300, 3)
    docs = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, " \n"), (903, "all velkins are dungheap " + "wa " * 40_000), (0, rows[0][1])]
    labels = [(i, y) for i, _, y in rows] + [(1, None), (5, 0), (5, 1), (None, 1), (7777, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as toxic", "true as flagged")
    packed = fit_on(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [tuple(r) for r in score_documents(d, packed).collect()]
    assert len(got) == len(docs)
    by = {i: (s, f) for i, s, f in got}
    assert by[900] == by[901] == by[902] == (0.0, False) and by[903][1]
    none = fit_on(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {(r.score, r.flagged) for r in score_documents(d, none).collect()} == {(0.0, False)}
    assert score_documents(d.limit(0), packed).count() == 0
