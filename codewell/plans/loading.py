"""Queries of vector search, acoustic words, loading conventions and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.functions import tags, vectors, weights
from codewell.operators import knn, postings, quality, quantize, rank
from codewell.runtime import cut, table

DIM, FRAMES = 1000, 20
#: The words of the acoustic query and how often each occurs.
ACOUSTIC_QUERY = ((0, 3), (2, 1), (5, 2), (77, 4))


# -- vectors ---------------------------------------------------------------------------------------------------------------


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "fashion_images").select("id", F.col("histograma_visual").alias("vector"))


def vector_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten stored pictures nearest to the first usable one."""
    items = _images(spark, sf_dir)
    first = items.where(vectors.is_usable(F.col("vector"), DIM)).groupBy().agg(F.min_by("vector", "id").alias("vector"))
    return knn.knn(items, first.select(F.lit(0).cast("long").alias("query_id"), "vector"), 10, DIM).select("place", "id", F.round("distance", 6).alias("distance"), "score")


def vector_knn_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query picture without any feature: every distance is NaN, ids decide."""
    query = spark.range(1).select(F.col("id").alias("query_id"), F.array_repeat(F.lit(0.0), DIM).alias("vector"))
    return knn.knn(_images(spark, sf_dir), query, 10, DIM).select("place", "id", "distance")


def vector_knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest pictures of every picture whose id is divisible by 50, against all pictures."""
    items = _images(spark, sf_dir)
    usable = items.where(vectors.is_usable(F.col("vector"), DIM))
    asked = usable.where("id % 50 = 0").select(F.col("id").cast("long").alias("query_id"), "vector")
    return knn.knn(usable, asked, 5, DIM).select("query_id", "place", "id", F.round("distance", 6).alias("distance"), "score")


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word_id, centroid)``: the mean vector of each label."""
    flat = table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = flat.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.col("label").alias("word_id"), F.transform("v", lambda s: s["x"]).alias("centroid"))


def vector_l2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean distances between the codebook's centroids (a codebook is of bounded size)."""
    c = label_centroids(spark, sf_dir)
    a, b = c.select(F.col("word_id").alias("a"), F.col("centroid").alias("x")), c.select(F.col("word_id").alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(vectors.l2(F.col("x"), F.col("y")), 6).alias("distance"))


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").select("vec_id", (F.floor(F.col("vec_id") / FRAMES)).cast("long").alias("item_id"), F.col("embedding").alias("vector"))
    return quantize.assign(frames, label_centroids(spark, sf_dir), keep=("vec_id", "item_id"))


def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest centroid of every frame."""
    return _assigned(spark, sf_dir).select("vec_id", "word_id", F.round("distance", 5).alias("distance"))


def histogram_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of every item of twenty frames."""
    return quantize.histogram(_assigned(spark, sf_dir))


def histogram_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one vector per item, written out as text."""
    dense = quantize.dense_histogram(histogram_sparse(spark, sf_dir), 10)
    return dense.select("item_id", F.array_join(F.transform("histogram", lambda x: x.cast("int").cast("string")), " ").alias("histogram"))


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained codebook: centroids and their lengths."""
    book = quantize.fit_kmeans(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector")), k=16)
    return book.select("word_id", F.size("centroid").alias("dim"), F.round(vectors.norm(F.col("centroid")), 6).alias("length"))


# -- acoustic words ----------------------------------------------------------------------------------------------------------


def _acoustic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, idf and magnitudes: raw frequencies, N counted in the index."""
    # frames are quantised once for all that follows
    post = cut(histogram_sparse(spark, sf_dir).select(F.col("word_id").alias("term"), F.col("item_id").alias("chunk_id"), "tf"))
    n = post.agg(F.countDistinct("chunk_id").alias("n"))
    idf = cut(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", weights.smooth_idf(F.col("n"), F.col("df")).alias("idf")))
    return post, idf, postings.norms(post, idf.select("term", "idf"), weights.RAW)


def acoustic_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and idf of every acoustic word."""
    return _acoustic(spark, sf_dir)[1].select(F.col("term").alias("word_id"), "df", F.round("idf", 6).alias("idf"))


def acoustic_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes of the items' weight vectors."""
    return _acoustic(spark, sf_dir)[2].select(F.col("chunk_id").alias("item_id"), F.round("norm_value", 6).alias("norm_value"))


def acoustic_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items most similar to a histogram; words that no item has are dropped."""
    post, idf, norm = _acoustic(spark, sf_dir)
    asked = spark.createDataFrame([(0, w, tf, i) for i, (w, tf) in enumerate(ACOUSTIC_QUERY)], "query_id long, term int, tf long, pos int")
    vector = rank.query_vector(asked, idf.select("term", "idf"), weights.RAW)
    top = rank.top_k(rank.scores(vector, post, norm, weights.RAW), 5, "cosine")
    return top.select("place", F.col("chunk_id").alias("item_id"), F.round("cosine", 6).alias("similarity"))


# -- loading and integrity ---------------------------------------------------------------------------------------------------


def codebook_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable, dead, wrong and missing vectors among the picture lines."""
    return quality.vector_audit(table(spark, sf_dir, "vectores_fashion"), "histograma", DIM)


def upsert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the picture lines that an insert-if-absent load would add."""
    lines, stored = table(spark, sf_dir, "vectores_fashion"), table(spark, sf_dir, "fashion_images")
    good = lines.where(F.coalesce(F.size("histograma") == DIM, F.lit(False)) & F.col("nombre_archivo").isNotNull())
    return good.select("nombre_archivo").distinct().join(stored.select("nombre_archivo"), "nombre_archivo", "left_anti")


def load_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, ignored and erroneous lines of that load."""
    lines = table(spark, sf_dir, "vectores_fashion")
    ok = F.coalesce(F.size("histograma") == DIM, F.lit(False)) & F.col("nombre_archivo").isNotNull()
    return quality.load_counters(lines, ok, "nombre_archivo", table(spark, sf_dir, "fashion_images"))


def audio_first_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per file name, the smallest id: what a load with a unique file name keeps."""
    audio = table(spark, sf_dir, "audio_dataset").where("filename is not null")
    return audio.groupBy("filename").agg(F.min("audio_id").alias("audio_id"), F.count(F.lit(1)).alias("n_rows"))


def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that refer to nothing: index terms without codebook entry, norms without paragraph, picture lines not yet stored."""
    a = quality.orphans(table(spark, sf_dir, "term_index"), "term", table(spark, sf_dir, "codebook"))
    b = quality.orphans(table(spark, sf_dir, "doc_norms"), "chunk_id", table(spark, sf_dir, "metadata"))
    c = quality.orphans(table(spark, sf_dir, "vectores_fashion"), "nombre_archivo", table(spark, sf_dir, "fashion_images"))
    name = lambda df, what, key: df.select(F.lit(what).alias("relation"), F.col(key).cast("string").alias("key"))
    return name(a, "term_index", "term").unionByName(name(b, "doc_norms", "chunk_id")).unionByName(name(c, "vectores_fashion", "nombre_archivo"))


def pk_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written more than once, by relation."""
    parts = [("metadata", "chunk_id"), ("doc_norms", "chunk_id"), ("audio_dataset", "audio_id"), ("fashion_images", "id"), ("term_index", "segment_no")]
    rows = [quality.duplicates(table(spark, sf_dir, t), [k]).select(F.lit(t).alias("relation"), F.col(k).cast("string").alias("key"), "n") for t, k in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "audio_dataset").drop("audio_data").distinct()


def metadata_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs as shown: missing texts and durations have defaults."""
    shown = [tags.or_unknown(F.col(c)).alias(n) for c, n in (("title", "title"), ("collaborators", "artist"), ("album", "album"))]
    return _audio(spark, sf_dir).select("audio_id", "filename", *shown, tags.or_zero(F.col("duration_seconds")).alias("duration_seconds"))


def audio_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address and media type of every song's sound."""
    return _audio(spark, sf_dir).select("audio_id", tags.audio_url("http://localhost:8000", F.col("audio_id")).alias("url"), tags.media_type(F.col("content_type")).alias("media_type"))


def track_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track numbers out of texts like ``3/12``; other texts give NULL."""
    text = F.coalesce(F.concat(F.col("track_number").cast("string"), F.lit("/12")), F.col("album"))
    return _audio(spark, sf_dir).select("audio_id", text.alias("raw"), tags.track_number(text).alias("track"))


def suffix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names accepted as sound (case-sensitive) or as picture (any case)."""
    names = _audio(spark, sf_dir).select(F.col("filename").alias("name")).unionByName(table(spark, sf_dir, "vectores_fashion").select(F.col("nombre_archivo").alias("name")))
    return names.where("name is not null").distinct().select("name", tags.is_audio(F.col("name")).alias("is_audio"), tags.is_image(F.col("name")).alias("is_image"))


def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names out of paths in several styles."""
    paths = table(spark, sf_dir, "vectores_fashion").where("ruta_original is not null").select("ruta_original").distinct()
    return paths.select("ruta_original", tags.basename(F.col("ruta_original")).alias("file"))


def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of twenty songs in id order."""
    return _audio(spark, sf_dir).orderBy("audio_id").offset(20).limit(20).select("audio_id", "filename")


QUERIES = {f.__name__: f for f in (
    vector_knn_cosine, vector_knn_zero_query, vector_knn_batch, vector_l2_pairs, nearest_centroid, histogram_sparse, histogram_dense, kmeans_fit, acoustic_idf, acoustic_norms,
    acoustic_search_topk, codebook_audit, upsert_ignore, load_counters, audio_first_per_file, fk_orphans, pk_duplicates, metadata_defaults, audio_urls, track_parse, suffix_filter, image_paths, page_scan,
)}

_ITEMS = f"""
WITH items AS (
  SELECT id, CAST(histograma_visual AS DOUBLE[]) AS v FROM fashion_images
  WHERE len(histograma_visual) = {DIM} AND len(list_filter(histograma_visual, lambda x: x IS NULL)) = 0),
usable AS (SELECT * FROM items WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
"""
_NEAR = """, near AS (
  SELECT query_id, i.id, round(coalesce(1 - list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)), 0), 'NaN'::DOUBLE), 9) + 0.0 AS distance
  FROM items i, asked),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS place FROM near)
"""
_CENTROIDS = """
WITH centroids AS MATERIALIZED (
  SELECT label AS word_id, list(x ORDER BY i) AS c FROM (
    SELECT label, i, round(avg(x), 9) AS x FROM (
      SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL)
    GROUP BY label, i) GROUP BY label)
"""
_HISTOGRAM = _CENTROIDS + f""",
assigned AS MATERIALIZED (
  SELECT vec_id, vec_id // {FRAMES} AS item_id, word_id, distance FROM (
    SELECT vec_id, word_id, list_distance(CAST(embedding AS DOUBLE[]), c) AS distance,
      row_number() OVER (PARTITION BY vec_id ORDER BY round(pow(list_distance(CAST(embedding AS DOUBLE[]), c), 2), 9), word_id) AS r
    FROM embeddings, centroids) WHERE r = 1),
postings AS MATERIALIZED (SELECT item_id, word_id, count(*) AS tf FROM assigned GROUP BY item_id, word_id),
idf AS (SELECT word_id, count(*) AS df, ln(((SELECT count(DISTINCT item_id) FROM postings) + 1.0) / (count(*) + 1.0)) + 1 AS idf FROM postings GROUP BY word_id),
norms AS (SELECT item_id, sqrt(sum(pow(tf * idf, 2))) AS norm_value FROM postings JOIN idf USING (word_id) GROUP BY item_id)
"""
_AUDIO = "(SELECT DISTINCT * EXCLUDE (audio_data) FROM audio_dataset)"
_GOOD = f"coalesce(len(histograma) = {DIM}, false) AND nombre_archivo IS NOT NULL"
SQL = {
    "vector_knn_cosine": _ITEMS + ", asked AS (SELECT CAST(0 AS BIGINT) AS query_id, arg_min(v, id) AS q FROM usable)" + _NEAR
    + "SELECT place, id, round(distance, 6) AS distance, round(1 - distance, 4) AS score FROM ranked WHERE place <= 10",
    "vector_knn_zero_query": _ITEMS + f", asked AS (SELECT CAST(0 AS BIGINT) AS query_id, list_transform(range({DIM}), lambda x: 0.0::DOUBLE) AS q)" + _NEAR
    + "SELECT place, id, distance FROM ranked WHERE place <= 10",
    "vector_knn_batch": _ITEMS + ", asked AS (SELECT CAST(id AS BIGINT) AS query_id, v AS q FROM usable WHERE id % 50 = 0)" + _NEAR.replace("FROM items i", "FROM usable i")
    + "SELECT query_id, place, id, round(distance, 6) AS distance, round(1 - distance, 4) AS score FROM ranked WHERE place <= 5",
    "vector_l2_pairs": _CENTROIDS + "SELECT a.word_id AS a, b.word_id AS b, round(list_distance(a.c, b.c), 6) AS distance FROM centroids a JOIN centroids b ON a.word_id < b.word_id",
    "nearest_centroid": _HISTOGRAM + "SELECT vec_id, word_id, round(distance, 5) AS distance FROM assigned",
    "histogram_sparse": _HISTOGRAM + "SELECT item_id, word_id, tf FROM postings",
    "histogram_dense": _HISTOGRAM + """SELECT item_id, array_to_string(list_transform(range(10), lambda w: coalesce(map_extract(map_from_entries(h), CAST(w AS INTEGER))[1], 0)), ' ') AS histogram
FROM (SELECT item_id, list({'k': word_id, 'v': tf}) AS h FROM postings GROUP BY item_id)""",
    "acoustic_idf": _HISTOGRAM + "SELECT word_id, df, round(idf, 6) AS idf FROM idf",
    "acoustic_norms": _HISTOGRAM + "SELECT item_id, round(norm_value, 6) AS norm_value FROM norms",
    "acoustic_search_topk": _HISTOGRAM + f""",
asked AS (SELECT * FROM (VALUES {", ".join(f"({w}, {tf}, {i})" for i, (w, tf) in enumerate(ACOUSTIC_QUERY))}) AS t(word_id, qtf, pos)),
vector AS (SELECT word_id, pos, idf, qtf * idf AS weight, sqrt(sum(pow(qtf * idf, 2)) OVER ()) AS query_norm FROM asked JOIN idf USING (word_id)),
dots AS (SELECT item_id, sum(weight * tf * idf) AS dot, min(pos) AS first_pos, any_value(query_norm) AS qn FROM postings JOIN vector USING (word_id) GROUP BY item_id),
top AS (
  SELECT item_id, s, CAST(row_number() OVER (ORDER BY s DESC, first_pos, item_id) AS INTEGER) AS place FROM (
    SELECT item_id, first_pos, round(dot / (qn * norm_value), 9) AS s FROM dots JOIN norms USING (item_id)))
SELECT place, item_id, round(s, 6) AS similarity FROM top WHERE place <= 5""",
    "codebook_audit": f"""SELECT count(*) AS n, count(*) FILTER (histograma IS NULL) AS n_null, count(*) FILTER (len(histograma) <> {DIM}) AS n_wrong_length,
  count(*) FILTER (len(list_filter(histograma, lambda x: isnan(x) OR isinf(x))) > 0) AS n_nan,
  count(*) FILTER (len(histograma) > 0 AND len(list_filter(histograma, lambda x: x IS NULL OR x <> 0)) = 0) AS n_dead,
  count(*) FILTER (len(histograma) = {DIM} AND len(list_filter(histograma, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(histograma, lambda x: x <> 0)) > 0) AS n_usable
FROM vectores_fashion""",
    "upsert_ignore": f"""SELECT DISTINCT nombre_archivo FROM vectores_fashion WHERE {_GOOD}
AND nombre_archivo NOT IN (SELECT nombre_archivo FROM fashion_images WHERE nombre_archivo IS NOT NULL)""",
    "load_counters": f"""
WITH good AS (SELECT nombre_archivo FROM vectores_fashion WHERE {_GOOD}),
fresh AS (SELECT DISTINCT nombre_archivo FROM good WHERE nombre_archivo NOT IN (SELECT nombre_archivo FROM fashion_images WHERE nombre_archivo IS NOT NULL))
SELECT (SELECT count(*) FROM fresh) AS inserted, (SELECT count(*) FROM good) - (SELECT count(*) FROM fresh) AS ignored,
  (SELECT count(*) FROM vectores_fashion) - (SELECT count(*) FROM good) AS errors""",
    "audio_first_per_file": "SELECT filename, min(audio_id) AS audio_id, count(*) AS n_rows FROM audio_dataset WHERE filename IS NOT NULL GROUP BY filename",
    "fk_orphans": """
SELECT DISTINCT 'term_index' AS relation, term AS key FROM term_index WHERE term IS NOT NULL AND term NOT IN (SELECT term FROM codebook WHERE term IS NOT NULL)
UNION ALL SELECT DISTINCT 'doc_norms', CAST(chunk_id AS VARCHAR) FROM doc_norms WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM metadata WHERE chunk_id IS NOT NULL)
UNION ALL SELECT DISTINCT 'vectores_fashion', nombre_archivo FROM vectores_fashion WHERE nombre_archivo IS NOT NULL
  AND nombre_archivo NOT IN (SELECT nombre_archivo FROM fashion_images WHERE nombre_archivo IS NOT NULL)""",
    "pk_duplicates": " UNION ALL ".join(
        f"SELECT '{t}' AS relation, CAST({k} AS VARCHAR) AS key, count(*) AS n FROM {t} GROUP BY {k} HAVING count(*) > 1"
        for t, k in (("metadata", "chunk_id"), ("doc_norms", "chunk_id"), ("audio_dataset", "audio_id"), ("fashion_images", "id"), ("term_index", "segment_no"))
    ),
    "metadata_defaults": f"""SELECT audio_id, filename, coalesce(nullif(title, ''), '{tags.UNKNOWN}') AS title, coalesce(nullif(collaborators, ''), '{tags.UNKNOWN}') AS artist,
  coalesce(nullif(album, ''), '{tags.UNKNOWN}') AS album, coalesce(duration_seconds, 0.0::DOUBLE) AS duration_seconds FROM {_AUDIO}""",
    "audio_urls": f"SELECT audio_id, 'http://localhost:8000/audio/stream/' || audio_id AS url, coalesce(nullif(content_type, ''), 'audio/mpeg') AS media_type FROM {_AUDIO}",
    "track_parse": f"""SELECT audio_id, raw, TRY_CAST(split_part(raw, '/', 1) AS INTEGER) AS track FROM (
  SELECT audio_id, coalesce(CAST(track_number AS VARCHAR) || '/12', album) AS raw FROM {_AUDIO})""",
    "suffix_filter": f"""SELECT DISTINCT name, regexp_matches(name, '\\.(mp3|wav|ogg)$') AS is_audio, regexp_matches(lower(name), '\\.(png|jpg|jpeg|webp)$') AS is_image FROM (
  SELECT filename AS name FROM {_AUDIO} UNION ALL SELECT nombre_archivo FROM vectores_fashion) WHERE name IS NOT NULL""",
    "image_paths": "SELECT DISTINCT ruta_original, regexp_extract(ruta_original, '([^/\\\\]*)$', 1) AS file FROM vectores_fashion WHERE ruta_original IS NOT NULL",
    "page_scan": f"SELECT audio_id, filename FROM {_AUDIO} ORDER BY audio_id LIMIT 20 OFFSET 20",
}
