import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codewell.api import BadFormat, Engines, ImageSearch, NotFound, Unavailable
from codewell.functions import tags, vectors
from codewell.operators import knn, quality, quantize


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0.0, 0], [10, 0], [0, 10]])
    rows = [(i, i // 10, (centres[i % 3] + rng.normal(0, 0.3, 2)).tolist()) for i in range(120)] + [(500, 3, None)]
    return spark.createDataFrame(rows, "vec_id long, item_id long, vector array<double>")


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 10.0]), (3, [0.0, 0.0])], "word_id int, centroid array<double>")


def test_assign_and_histograms(frames, book):
    got = quantize.assign(frames, book, keep=("vec_id", "item_id"))
    assert {r.vec_id: r.word_id for r in got.collect()} == {i: i % 3 for i in range(120)}  # the tie of words 0 and 3 goes to 0
    sparse = quantize.histogram(got)
    assert sparse.agg(F.sum("tf")).first()[0] == 120
    assert {len(r.histogram) for r in quantize.dense_histogram(sparse, 2).collect()} == {2}
    assert quantize.assign(frames, book.limit(0), keep=("vec_id",)).count() == 0


def test_training(frames):
    rows = quantize.fit_kmeans(frames, 3).collect()
    assert sorted(tuple(round(x) for x in r.centroid) for r in rows) == [(0, 0), (0, 10), (10, 0)]
    model = quantize.MiniBatchKMeans(3, seed=4)
    with pytest.raises(ValueError):
        model.partial_fit(np.zeros((1, 2)))
    data = np.array([r.vector for r in frames.where("vector is not null").collect()])
    for a in range(0, 120, 40):
        model.partial_fit(data[a : a + 40])
    model.partial_fit(np.array([[np.nan, 0.0]]))
    assert len(model.rows()) == 3 and np.isfinite([c for _, c in model.rows()]).all()


def test_knn(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [None, 1.0])], "id int, vector array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    rows = knn.knn(items, asked, 5, 2).orderBy("query_id", "place").collect()
    assert [r.id for r in rows if r.query_id == 0] == [1, 4, 3, 2, 5]
    assert [r.id for r in rows if r.query_id == 1] == [1, 2, 3, 4, 5] and all(math.isnan(r.distance) for r in rows if r.query_id == 1)
    assert rows[0].score == 1.0 and rows[2].score == round(1 / math.sqrt(2), 4)


def test_scalars(spark):
    df = spark.createDataFrame([(None, None, None, "a/b\\c.JPG", "3/12"), ("", 0.0, "", "x.MP3", "x"), ("t", 2.5, "audio/ogg", "x.ogg", None)], "t string, d double, m string, p string, n string")
    rows = df.select(tags.or_unknown(F.col("t")), tags.or_zero(F.col("d")), tags.media_type(F.col("m")), tags.basename(F.col("p")), tags.is_audio(F.col("p")), tags.is_image(F.col("p")), tags.track_number(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("Desconocido", 0.0, "audio/mpeg", "c.JPG", False, True, 3), ("Desconocido", 0.0, "audio/mpeg", "x.MP3", False, False, None), ("t", 2.5, "audio/ogg", "x.ogg", True, False, None)]
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = v.select(vectors.norm(F.col("a")), vectors.l2(F.col("a"), F.col("b")), vectors.cosine_distance(F.col("a"), F.col("b"))).first()
    assert r[0] == r[1] == 5.0 and math.isnan(r[2])


def test_quality(spark):
    v = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    assert tuple(quality.vector_audit(v, "v", 2).first()) == (5, 1, 1, 1, 1, 1)
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", True), ("c", False), ("h", True)], "k string, ok boolean")
    held = spark.createDataFrame([("h",), ("h",)], "k string")
    assert tuple(quality.load_counters(rows, F.col("ok"), "k", held).first()) == (2, 2, 1)
    assert tuple(quality.load_counters(rows.limit(0), F.col("ok"), "k", held).first()) == (0, 0, 0)
    assert [r.k for r in quality.orphans(rows, "k", held).orderBy("k").collect()] == ["a", "b", "c"]
    assert [(r.k, r.n) for r in quality.duplicates(rows, ["k"]).collect()] == [("a", 2)]


def test_image_facade(spark):
    images = spark.createDataFrame([(1, "a.jpg", "/p/a.jpg", [1.0, 0.0]), (2, "b.jpg", "/p/b.jpg", [0.0, 1.0])], "id long, nombre_archivo string, ruta_original string, histograma_visual array<float>")
    engine = ImageSearch(images, dim=2)
    assert [(r.id, r.score, r.dataset_type) for r in engine.search_vector([0.0, 2.0], 2)] == [("2", 1.0, "prenda"), ("1", 0.0, "prenda")]
    assert engine.path(1) == "/p/a.jpg"
    with pytest.raises(NotFound):
        engine.path(9)
    with pytest.raises(BadFormat):
        engine.search(b"", "x.gif")
    with pytest.raises(Unavailable):
        engine.search(b"", "x.JPG")
    up = Engines(image=lambda: engine, audio=lambda: 1 / 0)
    assert up["image"] is engine
    with pytest.raises(Unavailable):
        up["audio"]
