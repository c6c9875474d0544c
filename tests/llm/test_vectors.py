import numpy as np
import pytest

from codewell.llm.clusters import cluster
from codewell.llm.neighbours import Quantizer, nearest_neighbours
from codewell.llm.vectors import one_per_item, pack_usable, unit_rows

DIM = 60


def make(rng, groups, alone):
    """Groups of near-copies of a sparse centre, and vectors of their own."""
    rows = []
    for g, size in enumerate(groups):
        centre = rng.random(DIM) * (rng.random(DIM) < 0.3) * 9
        centre[g % DIM] += 9
        rows += [(f"g{g}_{k}", (centre * (0.9 + 0.2 * rng.random(DIM))).tolist()) for k in range(size)]
    for k in range(alone):
        v = np.zeros(DIM)
        v[rng.choice(DIM, 4, replace=False)] = 5
        rows.append((f"s{k}", v.tolist()))
    return rows


def frame(spark, rows):
    return pack_usable(spark.createDataFrame(rows, "id string, v array<double>").selectExpr("id", "v", "1 as packed"), "id", "v", DIM)


def test_packing_keeps_every_digit():
    from codewell.llm.vectors import pack_rows, unpack

    rng = np.random.default_rng(1)
    x = np.zeros((7, 2000))
    for k, kind in enumerate(("u1", "f4", "f8", "u1", "f8", "u1", "f4")):
        at = rng.choice(2000 if k > 2 else 200, 40 if k < 5 else 3, replace=False)
        x[k, at] = rng.integers(1, 255, len(at)) if kind == "u1" else rng.random(len(at)).astype(kind) - 0.5
    rows, cols = np.nonzero(x)
    packed = pack_rows(rows, cols, x[rows, cols], len(x))
    back = np.zeros_like(x)
    r, c, v = unpack(packed)
    back[r, c] = v
    assert (back == x).all() and (np.diff(r) >= 0).all() and len({p[0] for p in packed}) >= 4
    assert len(unpack([])[0]) == 0


DIRTY = [("n0", None), ("n1", [1.0] * 3), ("n2", [0.0] * DIM), ("n3", [float("nan")] + [1.0] * (DIM - 1)), ("n4", [None] + [1.0] * (DIM - 1)), (None, [1.0] * DIM)]


def test_packing(spark):
    rows = [("a", [0.0] * (DIM - 1) + [2.0]), ("a", [0.0] * (DIM - 1) + [2.0]), *DIRTY]
    got = one_per_item(frame(spark, rows), frame(spark, rows)).collect()
    assert [r.id for r in got] == ["a"]
    assert unit_rows([bytes(got[0].packed)], DIM)[0, -1] == 1.0
    assert frame(spark, rows).limit(0).count() == 0


def exact(rows, k):
    ids = sorted(i for i, _ in rows)
    x = np.array([dict(rows)[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return ids, s, {i: [ids[j] for j in np.lexsort((np.arange(len(ids)), -s[r]))[:k]] for r, i in enumerate(ids)}


def test_neighbours_against_brute_force(spark):
    rows = make(np.random.default_rng(2), [40, 9, 7, 120], 60)
    rows += [("copy", rows[0][1])]
    ids, s, want = exact(rows, 5)
    got = {}
    for r in nearest_neighbours(one_per_item(frame(spark, rows + rows[:5] + DIRTY)), DIM, 5, parts=20, probes=6).collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.similarity)
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    hit = sum(len(set(want[i]) & {o for o, _ in got[i].values()}) for i in ids) / (5 * len(ids))
    assert hit >= 0.95
    assert got["copy"][1] == (rows[0][0], 1.0)
    assert all(sim == s[ids.index(i), ids.index(o)] for i in ids for o, sim in got[i].values())


def _neighbours(df, **options):
    got = {}
    for r in nearest_neighbours(df, DIM, 5, parts=20, **options).collect():
        got.setdefault(r.id, {})[r.rank] = (r.other, r.similarity)
    return {i: [v[k] for k in sorted(v)] for i, v in got.items()}


def test_lists_of_directions_and_offsets(spark, monkeypatch):
    """More lists than directions: each direction is refined by offsets."""
    import codewell.llm.neighbours as n

    rows = make(np.random.default_rng(8), [30, 25, 40, 9], 40)
    ids, s, want = exact(rows, 5)
    monkeypatch.setattr(n, "LIST", 8)
    monkeypatch.setattr(n, "TOP", 5)
    x = unit_rows([r.packed for r in frame(spark, rows).collect()], DIM, "float32")
    model = n.Quantizer.train(x, len(x) // 8, 20)
    assert len(model.top) == 5 and len(model.sub) == 4
    lists, inner = model.foremost(x, 3)
    assert np.allclose([(model.direction(lists[:, k]) * x).sum(1) for k in range(3)], inner.T, atol=1e-5) and (np.diff(inner, axis=1) <= 1e-6).all()
    assert np.allclose((model.direction(np.arange(20)) ** 2).sum(1), 1, atol=1e-5)
    got = _neighbours(frame(spark, rows), probes=14)
    assert sum(len({o for o, _ in got[i]} & set(want[i])) for i in ids) >= 0.9 * 5 * len(ids)


def test_a_third_of_all_rows_are_copies(spark):
    rows = make(np.random.default_rng(9), [12, 9], 20)
    rows += [(f"z{k:02}", rows[0][1]) for k in range(22)]
    ids, s, want = exact(rows, 5)
    got = _neighbours(frame(spark, rows))
    assert set(got) == set(ids)
    assert all([o for o, _ in got[i]] == want[i] for i in ids if i.startswith("z") or i == rows[0][0])
    assert sum(len({o for o, _ in got[i]} & set(want[i])) for i in ids) >= 0.95 * 5 * len(ids)


def test_least_similarity_only_drops_what_is_below(spark):
    df = frame(spark, make(np.random.default_rng(3), [15, 8, 3], 30))
    whole, some = _neighbours(df), _neighbours(df, least=0.7)
    assert some == {i: kept for i, v in whole.items() if (kept := [p for p in v if p[1] >= 0.7])}


@pytest.mark.parametrize("rows", [[], [("a", [1.0] * DIM)], [("a", [1.0] * DIM), ("b", [1.0] * DIM)]])
def test_tiny_inputs(spark, rows):
    packed = frame(spark, rows)
    assert nearest_neighbours(packed, DIM).count() == (2 if len(rows) == 2 else 0)
    members, comps = cluster(packed, DIM, 0.7)
    assert members.count() == len(rows) and comps.count() == (1 if rows else 0)


def test_clusters_against_brute_force(spark):
    rows = make(np.random.default_rng(5), [30, 12, 5, 6, 4], 25)
    ids, s, _ = exact(rows, 1)
    alike = s >= 0.7
    hood = {i: frozenset({i, *(ids[j] for j in np.flatnonzero(alike[r]))}) for r, i in enumerate(ids)}
    members, comps = cluster(one_per_item(frame(spark, rows + DIRTY)), DIM, 0.7)
    tight = {r.component for r in comps.where("tight").collect()}
    got = {}
    for r in members.collect():
        got.setdefault(r.component, set()).add(r.id)
    want = {frozenset(h) for i, h in hood.items() if all(hood[j] == h for j in h)}
    assert {frozenset(v) for c, v in got.items() if c in tight} == want and len(want) > 8


def test_loose_component_is_split(spark):
    """A chain of four, each like the next only, and blocks smaller than the group."""
    def turn(a):
        v = np.zeros(DIM)
        v[:2] = np.cos(a), np.sin(a)
        return (v + 1e-9).tolist()

    rows = [(f"c{k}", turn(0.2 + 0.6 * k)) for k in range(3)]
    members, comps = cluster(frame(spark, rows), DIM, 0.7)
    got = {r.id: r.medoid for r in members.collect()}
    assert comps.count() in (1, 2, 3) and set(got) == {"c0", "c1", "c2"}
    assert got["c1"] == "c1" or len(set(got.values())) == 3


def test_many_blocks(spark, monkeypatch):
    import codewell.llm.clusters as c
    import codewell.llm.neighbours as n

    rows = make(np.random.default_rng(6), [60, 5], 5)
    whole = {r.id: r.medoid for r in cluster(frame(spark, rows), DIM, 0.7)[0].collect()}
    monkeypatch.setattr(c, "BLOCK", 7)
    monkeypatch.setattr(n, "BLOCK", 7)
    assert {r.id: r.medoid for r in cluster(frame(spark, rows), DIM, 0.7)[0].collect()} == whole
    ids, _, want = exact(rows, 5)
    got = {}
    for r in nearest_neighbours(frame(spark, rows), DIM, 5, parts=20, probes=8).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert sum(len(got[i] & set(want[i])) for i in ids) >= 0.9 * 5 * len(ids)


def test_links_without_cosine_do_not_hide_a_group(spark):
    def peak(at, more):
        v = np.zeros(DIM)
        v[:10] = 1
        v[at] = 10 + more
        return v.tolist()

    rows = [(f"a{k}", peak(0, 0.1 * k)) for k in range(5)] + [("z", peak(9, 0))]  # equal positions, other weights
    members, comps = cluster(frame(spark, rows), DIM, 0.7)
    assert {(r.component, r.size, r.tight) for r in comps.collect()} == {("a0", 5, True), ("z", 1, True)}
    assert {(r.id, r.component) for r in members.collect()} == {(f"a{k}", "a0") for k in range(5)} | {("z", "z")}


def test_a_hot_garment_in_blocks(spark, monkeypatch):
    """One garment owns half of all rows, with copies; its degrees follow from angles, those of loose groups from blocks."""
    import codewell.llm.clusters as c

    rng = np.random.default_rng(12)
    rows = make(rng, [90, 6], 20)
    rows += [(f"copy{k:02}", rows[3][1]) for k in range(40)] + [(f"far{k}", [v * (0.2 if j % 3 else 2.4) for j, v in enumerate(rows[0][1])]) for k in range(3)]
    ids, s, _ = exact(rows, 1)
    alike = s >= 0.7
    hood = {i: frozenset({i, *(ids[j] for j in np.flatnonzero(alike[r]))}) for r, i in enumerate(ids)}
    want = {h for h in hood.values() if len(h) >= 5 and all(hood[j] == h for j in h)}
    df = frame(spark, rows)
    answers = []
    for block, bucket in ((1000, 20_000), (25, 30)):
        monkeypatch.setattr(c, "BLOCK", block)
        monkeypatch.setattr(c, "BUCKET", bucket)
        got = {}
        for r in c.tight_groups(df, DIM, 0.7, 5).collect():
            got.setdefault(r.component, set()).add(r.id)
        assert {frozenset(v) for v in got.values()} == want
        members, comps = c.cluster(df, DIM, 0.7)
        answers.append({(r.id, r.component, r.medoid, r.degree, r.total) for r in members.collect()})
        assert comps.agg({"size": "sum"}).first()[0] == len(rows)
    assert answers[0] == answers[1]


def test_leaders_of_buckets():
    from codewell.llm.clusters import _leaders

    bucket, sketch = np.array([0, 0, 0, 0, 1, 1]), [np.array([5, 6, 6, 9, 5, 7]), np.array([1, 2, 3, 3, 1, 4])]
    assert _leaders(bucket, sketch).tolist() == [0, 1, 1, 1, 4, 5]


def test_lists_of_many_directions_are_asked():
    """With offsets the foremost lists are those of all directions, not of four."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.sqrt((v * v).sum(1, keepdims=True))
    top, sub = unit(rng.normal(size=(40, 16))), rng.normal(size=(3, 16)) * 0.05
    model = Quantizer(top, sub, np.zeros((4, 1, 4)))
    x = unit(rng.normal(size=(50, 16)))
    lists, inner = model.foremost(x, 24)
    every = x @ model.direction(np.arange(120)).T
    best = np.sort(every, axis=1)[:, ::-1][:, :24]
    assert lists.shape == (50, 24) and np.allclose(inner, np.take_along_axis(every, lists, 1))
    assert np.abs(inner - best).max() < 1e-9


def test_pairs_near_the_jaccard_bound_are_linked(spark):
    """Pairs of sets with a Jaccard similarity of 3/7; and the foremost row of a bucket that shares a value itself."""
    import codewell.llm.clusters as c

    rng = np.random.default_rng(21)
    rows = []
    for k in range(300):
        at = rng.permutation(1000)[:28]
        for name, mine in (("a", at[:20]), ("b", at[8:])):
            v = np.zeros(1000)
            v[mine] = 1
            rows.append((f"{k:03}{name}", v.tolist()))
    packed = pack_usable(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 1000)
    edges = {tuple(sorted((r.a, r.b))) for r in c.similar_edges(packed, 1000).collect()}
    assert sum((f"{k:03}a", f"{k:03}b") in edges for k in range(300)) >= 0.95 * 300
    assert c._sharers(np.array([0, 0, 0, 1]), np.array([5, 6, 5, 5])).tolist() == [0, 1, 0, 3]
