import random

from codewell.llm.leaks import BLOCK, ItemIndex, edit_distance_within, find_leaks, words_of
from codewell.llm.plain import WordHashes


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_edit_distance_equals_dynamic_programme():
    rng = random.Random(1)
    for _ in range(500):
        p, t = [rng.randrange(5) for _ in range(rng.randint(1, 30))], [rng.randrange(5) for _ in range(rng.randint(0, 60))]
        assert edit_distance_within(p, t) == brute(p, t)


def test_words():
    assert words_of("<b>Él</b> DON’T\tgo [x3] away—now &amp; (bis) x2") == ["el", "dont", "go", "away", "now"]
    assert words_of(None) == words_of(" \n") == []


def altered(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        k, how = rng.randrange(len(out)), rng.choice("cma")
        if how == "c":
            out[k] = rng.choice(vocabulary)
        elif how == "m":
            del out[k]
        else:
            out.insert(k, rng.choice(vocabulary))
    return out


def test_search_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(draw(rng.randint(15, 90)))) for k in range(12)]
    docs = []
    for k in range(300):
        i = rng.randrange(12)
        w = items[i][1].split()
        a = rng.randrange(max(1, len(w) - 20))
        piece = altered(rng, w[a : a + rng.randint(14, 30)], rng.randint(0, 4), vocabulary)
        docs.append((k, " ".join(draw(rng.choice([0, 3, 50, 200])) + piece + draw(rng.choice([0, 5, 70])))))
    docs += [(900, None), (901, ""), (902, " "), (903, items[0][1]), (903, items[0][1]), (904, " ".join(draw(30_000)) + " " + items[3][1])]
    got = {(r.doc_id, r.item_id): r.edits for r in find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id"),
        spark.createDataFrame([*items, (50, None), (51, "short")], "item_id long, text string")).collect()}
    want = {}
    for d, t in dict(docs).items():
        for i, u in items:
            p, w = u.split(), (t or "").split()
            best = min((brute(p[a : a + 20], w) for a in range(len(p) - 19)), default=99) if len(w) < 1000 else 0 if i == 3 else 99
            if best <= 2:
                want[d, i] = best
    assert len(want) > 100 and got == want


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string"), items).count() == 0


def test_every_window_lies_in_a_block():
    text = [f"v{k}" for k in range(3 * BLOCK + 11)]
    hasher = WordHashes()
    for a in range(len(text) - 22):
        index = ItemIndex([(1, " ".join([*text[a : a + 5], "new", *text[a + 7 : a + 21]]))], 20, 2)
        assert index.search(hasher.of(text)), a


def test_text_between_angle_brackets_is_searched(spark):
    passage = " ".join(f"word{k}" for k in range(20))
    texts = [f"so <{passage}> it", f"so &lt;{passage}&gt; it", f"1 < 2 {passage} 3 > 2"]
    texts.append('so <p>word0</p> <br /> <A HREF="x y" class=z\n> <|end|> <!-- a note --> ' + passage[6:])
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    assert sorted((r.doc_id, r.edits) for r in find_leaks(docs, items).collect()) == [(str(k), 0) for k in range(4)]
