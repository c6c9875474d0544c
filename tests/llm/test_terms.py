import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codewell.llm.terms import BurstTrie, adaptive_routes, count_terms, pack, route_of, unpack


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=8), st.tuples(st.integers(1, 9), st.integers(1, 9)), max_size=80))
def test_pack_and_trie(terms):
    assert {t: (o, n) for t, o, n in unpack(pack({t: list(c) for t, c in terms.items()}))} == terms
    trie = BurstTrie(burst=3)
    for t, (o, n) in terms.items():
        trie.add(t, o, n)
        trie.add(t, 1, 0)
    assert {t: (o, n) for t, o, n in trie.terms()} == {t: (o + 1, n) for t, (o, n) in terms.items()}


def test_routes():
    sizes = [("a", 1), ("ab", 50), ("abc", 90), ("b", 4)]
    routes = adaptive_routes(sizes, 60)
    assert "ab" in routes and "abc" in routes and "b" in routes
    assert route_of("abcd", routes) == "abc" and route_of("abx", routes) == "ab" and route_of("zz", routes) == ""


@pytest.mark.parametrize("budget", [1, 40, 20_000])
def test_counts_equal_python(spark, budget):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(900)] + ["love"] * 400
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))).replace("love", rng.choice(["Love", "love!", "LOVE-"]))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \t\r\n"), (403, "日本 123"), (404, "hot " * 50_000), (None, "lost")]
    df = spark.createDataFrame(rows + rows[:30], "chunk_id int, text string").selectExpr("*", "1 as term", "2 as n")
    occurrences, records, n = Counter(), Counter(), 0
    for i, t in rows:
        if i is not None and t and t.strip(" \t\r\n"):
            found = re.findall("[a-z]+", t.lower())
            n += 1
            occurrences.update(found)
            records.update(set(found))
    terms, total = count_terms(df.repartition(5), budget=budget)
    assert {r.term: (r.occurrences, r.records) for r in terms.collect()} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert total.first()[0] == n
    none, zero = count_terms(df.limit(0))
    assert none.count() == 0 and zero.first()[0] == 0


def test_hot_prefix_is_refined_and_tries_are_flushed(spark, monkeypatch):
    """Nearly all terms share three letters; routes go deeper, and tasks send several tries."""
    import codewell.llm.terms as terms

    rng = random.Random(6)
    words = ["abc" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["q", "abd"]
    rows = [(i, " ".join(words[k::97])) for i, k in enumerate(range(97))]
    df = spark.createDataFrame(rows, "chunk_id int, text string").repartition(3)
    monkeypatch.setattr(terms, "FLUSH", 400)
    seen = []
    routes = terms._routes
    monkeypatch.setattr(terms, "_routes", lambda *a: seen.append(routes(*a)) or seen[-1])
    got = {r.term: r.occurrences for r in terms.count_terms(df, budget=60)[0].collect()}
    assert got == dict(Counter(words))
    assert max(map(len, seen[0])) > 4 and all(r[:-1] in seen[0] for r in seen[0] if r)


def test_drawn_out_words_need_no_depth(spark):
    """More drawn-out words than a container holds, each the beginning of the next: no recursion by letter, few passes for routes."""
    words = ["la" * n for n in range(300, 1100)] + ["na" * n for n in range(1, 30)]
    trie = BurstTrie()
    for w in words:
        trie.add(w, 1, 1)
    assert {t for t, _, _ in trie.terms()} == set(words)
    rows = [(i, " ".join(words[k::80])) for i, k in enumerate([*range(80), *range(40)])]
    df = spark.createDataFrame(rows, "chunk_id int, text string").repartition(3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {r.term: (r.occurrences, r.records) for r in count_terms(df, budget=100)[0].collect()}
    counts = Counter(w for _, t in rows for w in t.split())
    assert got == {w: (n, n) for w, n in counts.items()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 40
