import random
from collections import defaultdict

from codewell.operators import skew


def index(spark, rows):
    return spark.createDataFrame(rows, "term string, idf_value double, postings array<struct<chunk_id:int,tf:int>>, segment_no int").withColumnRenamed("idf_value", "tf")


def test_hot_term_and_dirt(spark):
    rng = random.Random(2)
    rows = [("hot", 1.0, [(c, rng.randint(1, 4)) for c in range(s * 50, s * 50 + 50)], s) for s in range(80)]
    rows += [("cold", None, [(5, 2), (3, 2)], 90), ("cold", None, [(5, 2), (3, 2)], 91), ("cold", None, [(3, 7)], 92), ("none", None, [], 93), ("null", None, None, 94), (None, None, [(1, 1)], 95), ("part", None, [(None, 3), (4, None)], 96)]
    rows += rows[:7]
    want = defaultdict(dict)
    for t, _, p, _ in rows:
        for c, f in p or []:
            if t is not None and c is not None and f is not None:
                want[t][c] = max(f, want[t].get(c, 0))
    post = skew.distinct_postings(index(spark, rows))
    top = defaultdict(dict)
    for r in skew.top_ids(post, "term", "tf", "chunk_id", 3).collect():
        top[r.term][r["rank"]] = r.chunk_id
    assert {t: [v[k] for k in sorted(v)] for t, v in top.items()} == {t: sorted(v, key=lambda c: (-v[c], c))[:3] for t, v in want.items()}
    for r in skew.weighted_profile(skew.value_frequencies(post, "term", "tf"), "term", "tf", {"p50": 0.5, "p90": 0.9}).collect():
        v = sorted(want[r.term].values())
        mode = min(set(v), key=lambda x: (-v.count(x), x))
        q = lambda p, v=v: next(x for i, x in enumerate(v, 1) if i >= p * len(v))
        assert (r.n_rows, r.n_values, r.mode_value, r.max_value, r.p50, r.p90) == (len(v), len(set(v)), mode, v[-1], q(0.5), q(0.9))


def test_empty(spark):
    post = skew.distinct_postings(index(spark, []))
    assert skew.top_ids(post, "term", "tf", "chunk_id", 3).count() == 0
    assert skew.weighted_profile(skew.value_frequencies(post, "term", "tf"), "term", "tf", {"p50": 0.5}).count() == 0
