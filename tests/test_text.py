import math
import random

import pytest
from pyspark.sql import functions as F

from codewell.api import TextSearch
from codewell.functions.stem import porter, stem_terms
from codewell.functions.text import STOPWORDS, paragraphs, tokens
from codewell.operators import numbering, postings, rank

SONGS = [
    (0, "A", "x", "Dog cat dog\nsun\n\nMoon star"), (1, "B", "y", "the and of\n\ncat cat cat moon"),
    (2, "C", "z", "star star\n \ndog sun moon"), (3, "D", "w", "Dog cat dog\nsun"),
]


@pytest.fixture(scope="module")
def metadata(spark):
    songs = spark.createDataFrame(SONGS, "document_id long, title string, artist string, text string")
    parts = songs.select("document_id", "title", "artist", F.posexplode(paragraphs(F.col("text"))).alias("pos", "text")).where(F.size(tokens(F.col("text"))) > 0)
    return numbering.number_rows(parts, ["document_id", "pos"], "chunk_id")


def test_chunks(metadata):
    rows = {r.chunk_id: (r.document_id, r.text) for r in metadata.collect()}
    assert rows == {0: (0, "Dog cat dog sun"), 1: (0, "Moon star"), 2: (1, "cat cat cat moon"), 3: (2, "star star"), 4: (2, "dog sun moon"), 5: (3, "Dog cat dog sun")}


def test_index_stages(metadata):
    counts = postings.chunk_terms(postings.chunk_tokens(metadata))
    book = postings.codebook(postings.term_stats(counts), 4)
    assert [(r.term, r["rank"], r.cf, r.df) for r in book.orderBy("rank").collect()] == [("dog", 0, 5, 3), ("cat", 1, 5, 3), ("sun", 2, 3, 3), ("moon", 3, 3, 3)]
    idf = postings.idf_table(book, postings.chunk_count(counts))
    assert all(abs(r.idf - 1.559616) < 1e-6 for r in idf.collect())
    post = postings.postings(counts, book)
    packed = postings.pack(post)
    assert {r.term: [tuple(p) for p in r.postings] for r in packed.collect()} == {
        "cat": [(0, 1), (2, 3), (5, 1)], "dog": [(0, 2), (4, 1), (5, 2)], "moon": [(1, 1), (2, 1), (4, 1)], "sun": [(0, 1), (4, 1), (5, 1)]}
    assert sorted(map(tuple, postings.unpack(packed).collect())) == sorted(map(tuple, post.collect()))
    norms = {r.chunk_id: round(r.norm_value, 6) for r in postings.norms(post, idf).collect()}
    assert norms == {0: 2.997011, 1: 1.559616, 2: 2.782018, 4: 2.701334, 5: 2.997011}


@pytest.fixture(scope="module")
def engine(metadata):
    return TextSearch(metadata, 4)


@pytest.mark.parametrize(("query", "want"), [
    ("dog cat", [(0, 0, 0.846714, 0.846714, 1.0), (3, 5, 0.846714, 0.846714, 1.0), (1, 2, 0.292771, 0.585543, 0.5), (2, 4, 0.204124, 0.408248, 0.5)]),
    ("Dog! the DOG moon zebra", [(2, 4, 0.809598, 0.809598, 1.0), (0, 1, 0.304704, 0.609407, 0.5), (3, 5, 0.268399, 0.536799, 0.5), (1, 2, 0.170819, 0.341637, 0.5)]),
    ("zebra", []), ("", []),
])
def test_ranking(spark, engine, query, want):
    rows = engine.search_frame(rank.one_query(spark, query)).orderBy("place").collect()
    assert [(r.document_id, r.chunk_id, round(r.rank_key, 6), round(r.cosine, 6), round(r.coverage, 6)) for r in rows] == want


def test_facade(engine):
    hit = engine.search("dog cat", 1)[0]
    assert (hit.id, hit.dataset_type, hit.metadata["title"]) == ("0", "letra", "A") and abs(hit.score - 0.846714) < 1e-6


def test_own_text_scores_one(spark, engine):
    for text in ("cat cat cat moon", "dog sun moon"):
        best = engine.search_frame(rank.one_query(spark, text), 1).first()
        assert math.isclose(best.cosine, 1, abs_tol=1e-8) and best.coverage == 1.0


def fold(text):
    out, current = [], []
    for line in text.splitlines():
        line = line.strip()
        if line:
            current.append(line)
        elif current:
            out.append(" ".join(current))
            current = []
    return out + ([" ".join(current)] if current else [])


def test_paragraphs_and_tokens_equal_python(spark):
    import re

    rng = random.Random(8)
    letters = "abé I'T\n\n\r \t\x0b\x0c\x1c\x1e\x1f\x85\xa0 　K."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", paragraphs(F.col("t")).alias("p"), tokens(F.col("t")).alias("w")).collect():
        assert r.p == fold(texts[r.i]), repr(texts[r.i])
        assert r.w == [w for w in re.sub("[^a-z]+", " ", texts[r.i].lower()).split() if w not in STOPWORDS]
    assert spark.sql("select cast(null as string) t").select(paragraphs(F.col("t")).alias("p")).first().p is None


def test_porter_examples(spark):
    for word, stem in (pair.split(":") for pair in """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor
        sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky
        relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal
        triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust
        replacement:replac adoption:adopt communism:commun probate:probat rate:rate cease:ceas controll:control roll:roll""".split()):
        assert porter(word) == stem, word
    df = spark.createDataFrame([("cats",), ("cats",), (None,)], "term string")
    assert [tuple(r) for r in stem_terms(df).collect()] == [("cats", "cat")]


def test_dense_numbers(spark):
    df = spark.range(0, 1000, 3).selectExpr("id % 7 as a", "id as b")
    rows = sorted(map(tuple, numbering.number_rows(df, ["a", "b"], "n", start=5).select("a", "b", "n").collect()))
    assert [r[2] for r in rows] == list(range(5, 5 + len(rows)))
    assert numbering.number_rows(df.limit(0), ["a", "b"], "n").count() == 0
