"""Queries of text retrieval: paragraphs, tokens, codebook, index, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codewell.functions.stem import stem_terms
from codewell.functions.text import LINE_ENDS, SPACES, STOPWORDS, paragraphs, tokens
from codewell.operators import numbering, postings, rank
from codewell.runtime import cut, spread, table

#: Vocabulary cut, and the queries of the registered searches.
TOP_TERMS = 5000
QUERY = "love and the night never bell shadow, quiet river!"
REPEATED = "Love love LOVE never night night"
UNKNOWN_WORDS = "love zzyzzx qqqwx night"
ONLY_UNKNOWN = "zzyzzx qqqwx"
EMPTY = ""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph once."""
    return table(spark, sf_dir, "metadata").where("chunk_id is not null").dropDuplicates(["chunk_id"])


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents that hold a token, densely numbered in document and paragraph order."""
    docs = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    parts = docs.select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("pos", "chunk")).where(F.size(tokens(F.col("chunk"))) > 0)
    return numbering.number_rows(parts, ["doc_id", "pos"], "chunk_id").select("chunk_id", "doc_id", "pos", "chunk")


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct tokens of every paragraph that has one."""
    t = postings.chunk_tokens(chunks(spark, sf_dir))
    return t.select("chunk_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms"), F.array_join("tokens", " ").alias("tokens"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.chunk_terms(postings.chunk_tokens(chunks(spark, sf_dir)))


def term_cf_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection and chunk frequency of every term."""
    return postings.term_stats(_counts(spark, sf_dir)).select("term", "cf", "df")


def codebook_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent terms with their rank."""
    return postings.codebook(postings.term_stats(_counts(spark, sf_dir)), TOP_TERMS).select("term", "rank")


class Index:
    """Codebook, idf, postings and norms of the paragraphs.

    The texts are read, analysed and shuffled once, into the checkpointed term counts; codebook and idf are of bounded size and
    checkpointed too, postings and norms follow lazily.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.metadata = table(spark, sf_dir, "metadata")
        counts = cut(_counts(spark, sf_dir))
        self.book = cut(postings.codebook(postings.term_stats(counts), TOP_TERMS))
        self.idf = cut(postings.idf_table(self.book, postings.chunk_count(counts)))
        self.postings = postings.postings(counts, self.book)
        self.norms = postings.norms(self.postings, self.idf)

    def vector(self, queries: DataFrame) -> DataFrame:
        return rank.query_vector(rank.query_terms(queries), self.idf)

    def scores(self, queries: DataFrame) -> DataFrame:
        return rank.scores(self.vector(queries), self.postings, self.norms)


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed idf of the codebook."""
    return Index(spark, sf_dir).idf.select("term", F.round("idf", 6).alias("idf"))


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a token, tokens, vocabulary before the cut, documents."""
    counts = cut(_counts(spark, sf_dir))
    totals = postings.term_stats(counts).agg(F.count(F.lit(1)).alias("n_terms"), F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"))
    docs = table(spark, sf_dir, "metadata").where("chunk_id is not null").agg(F.countDistinct("document_id").alias("n_documents"))
    return postings.chunk_count(counts).crossJoin(totals).crossJoin(docs)  # one row each


def postings_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term frequencies per chunk over the codebook."""
    return Index(spark, sf_dir).postings.select("term", "chunk_id", "tf")


def postings_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted index in packed segments, written out as text."""
    packed = postings.pack(Index(spark, sf_dir).postings)
    text = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["chunk_id"].cast("string"), p["tf"].cast("string"))), " ")
    return packed.select("term", "segment", F.size("postings").alias("df"), text.alias("postings"))


def doc_norms_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of the paragraphs' weight vectors."""
    return Index(spark, sf_dir).norms.select("chunk_id", F.round("norm_value", 6).alias("norm_value"))


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the query terms that the codebook has."""
    v = rank.query_vector(rank.query_terms(rank.one_query(spark, REPEATED + " " + UNKNOWN_WORDS)), Index(spark, sf_dir).idf)
    return v.select("term", F.round("weight", 6).alias("weight"), F.round("query_norm", 6).alias("query_norm"), "n_terms")


def text_scores_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, coverage and rank key of every matching paragraph."""
    s = Index(spark, sf_dir).scores(rank.one_query(spark, QUERY))
    return s.select("chunk_id", F.round("cosine", 6).alias("cosine"), F.round("coverage", 6).alias("coverage"), F.round("rank_key", 6).alias("rank_key"))


_FOUND = "place int, document_id int, chunk_id int, title string, artist string, score double, coverage double, rank_key double, text string"


def _words(spark: SparkSession, text: str) -> list[str]:
    """Distinct tokens of one query; worked out on the driver without a job."""
    return rank.one_query(spark, text).select(F.array_distinct(tokens(F.col("text"))).alias("t")).first()["t"]


def _top(spark: SparkSession, sf_dir: str, text: str, k: int = 10) -> DataFrame:
    if not _words(spark, text):  # nothing to look for, nothing to build
        return spark.createDataFrame([], _FOUND)
    index = Index(spark, sf_dir)
    best = rank.best_per_document(index.scores(rank.one_query(spark, text)), index.metadata)
    top = rank.with_metadata(rank.top_k(best, k).drop("document_id"), index.metadata, k)
    return top.select(
        "place", "document_id", "chunk_id", "title", "artist", F.round("cosine", 6).alias("score"), F.round("coverage", 6).alias("coverage"), F.round("rank_key", 6).alias("rank_key"), "text"
    )


def text_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the ten best songs by their best paragraph."""
    return _top(spark, sf_dir, QUERY)


def text_search_repeat_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that repeats terms."""
    return _top(spark, sf_dir, REPEATED)


def text_search_oov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with words outside the vocabulary, which do not count for coverage."""
    return _top(spark, sf_dir, UNKNOWN_WORDS)


def text_search_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only unknown words: no row."""
    return _top(spark, sf_dir, ONLY_UNKNOWN)


def text_search_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty query: no row."""
    return _top(spark, sf_dir, EMPTY)


def batch_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts as queries in one plan, five songs each."""
    queries = table(spark, sf_dir, "benchmark").where("text is not null").dropDuplicates(["item_id"]).select(F.col("item_id").alias("query_id"), "text")
    index = Index(spark, sf_dir)
    top = rank.top_k(rank.batch_best(index.vector(queries), index.postings, index.norms, index.metadata), 5)
    return top.select("query_id", "place", "document_id", "chunk_id", F.round("rank_key", 6).alias("rank_key"))


def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query over stems: terms are mapped through the distinct vocabulary and counted again."""
    meta, raw = table(spark, sf_dir, "metadata"), cut(_counts(spark, sf_dir))
    terms = rank.query_terms(rank.one_query(spark, QUERY))
    stems = cut(stem_terms(raw.select("term").unionByName(terms.select("term"))))
    counts = cut(raw.join(stems, "term").groupBy(F.col("stem").alias("term"), "chunk_id").agg(F.sum("tf").alias("tf"), F.min("pos").alias("pos")))
    book = cut(postings.codebook(postings.term_stats(counts), TOP_TERMS))
    idf = cut(postings.idf_table(book, postings.chunk_count(counts)))
    post = postings.postings(counts, book)
    asked = terms.join(stems, "term").groupBy("query_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"), F.min("pos").alias("pos"))
    scored = rank.scores(rank.query_vector(asked, idf), post, postings.norms(post, idf))
    top = rank.top_k(rank.best_per_document(scored, meta), 10)
    return top.select("place", "document_id", "chunk_id", F.round("rank_key", 6).alias("rank_key"))


def _stored(spark: SparkSession, sf_dir: str, words: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """idf, postings and norms as stored: the idf in force last, each posting once, one norm per chunk.

    With the words of a query, only their segments are read: the filter reaches the scan, and postings are exploded behind it.
    """
    index = table(spark, sf_dir, "term_index").where("term is not null" if words is None else F.col("term").isin(words))
    idf = index.where("idf_value is not null").groupBy("term").agg(F.max_by("idf_value", "segment_no").alias("idf"))
    post = postings.unpack(index).where("chunk_id is not null and tf is not null").groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"))
    norm = table(spark, sf_dir, "doc_norms").where("norm_value is not null").groupBy("chunk_id").agg(F.max("norm_value").alias("norm_value"))
    return idf, post, norm


def term_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored idf and number of postings of the terms of a query, fetched as one batch."""
    idf, post, _ = _stored(spark, sf_dir, _words(spark, QUERY))
    found = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))
    return found.join(idf, "term").select("term", F.round("idf", 6).alias("idf"), "df", "cf")


def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query answered from the stored index and norms."""
    idf, post, norm = _stored(spark, sf_dir, _words(spark, QUERY))
    vector = rank.query_vector(rank.query_terms(rank.one_query(spark, QUERY)), idf)
    meta = table(spark, sf_dir, "metadata")
    top = rank.top_k(rank.best_per_document(rank.scores(vector, post, norm), meta), 10)
    return rank.with_metadata(top.drop("document_id"), meta, 10).select("place", "document_id", "chunk_id", "title", "artist", F.round("rank_key", 6).alias("rank_key"))


def index_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written as JSON pairs and read back: postings and occurrences per term."""
    from codewell.sources.formats import postings_from_json, postings_to_json

    index = table(spark, sf_dir, "term_index").where("term is not null and postings is not null")
    back = postings_from_json(postings_to_json(index.select("term", "segment_no", "postings")))
    flat = back.select("term", F.explode("postings").alias("p")).select("term", "p.chunk_id", "p.tf").where("chunk_id is not null and tf is not null")
    each = flat.groupBy("term", "chunk_id").agg(F.max("tf").alias("tf"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


QUERIES = {f.__name__: f for f in (
    text_chunks, text_tokens, term_cf_df, codebook_topk, idf_table, collection_stats, postings_flat, postings_packed, doc_norms_built, query_vector, text_scores_all,
    text_search_topk, text_search_repeat_terms, text_search_oov, text_search_unknown, text_search_empty, batch_text_search, stemmed_search, term_index_lookup, stored_index_search, index_json_roundtrip,
)}

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower({{}}), '[a-z]+'), lambda x: x NOT IN ({_STOP}))"
_CHUNKS = f"""
WITH chunks AS MATERIALIZED (
  SELECT chunk_id, any_value(document_id) AS document_id, any_value(title) AS title, any_value(artist) AS artist, any_value(text) AS text
  FROM metadata WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
tokened AS MATERIALIZED (SELECT chunk_id, t AS tokens FROM (SELECT chunk_id, {_TOKENS.format("text")} AS t FROM chunks) WHERE len(t) > 0),
flat AS MATERIALIZED (SELECT chunk_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM tokened),
stats AS MATERIALIZED (
  SELECT term, count(*) AS cf, count(DISTINCT chunk_id) AS df, min(chunk_id * 10000000::BIGINT + pos) AS first FROM flat GROUP BY term)
"""
_BOOK = _CHUNKS + f""",
book AS MATERIALIZED (
  SELECT term, CAST(row_number() OVER (ORDER BY cf DESC, first) - 1 AS INTEGER) AS rank, cf, df FROM stats ORDER BY cf DESC, first LIMIT {TOP_TERMS}),
idf AS MATERIALIZED (SELECT term, ln((n + 1.0) / (df + 1.0)) + 1 AS idf FROM book, (SELECT count(*) AS n FROM tokened)),
postings AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM book) GROUP BY term, chunk_id),
norms AS MATERIALIZED (SELECT chunk_id, sqrt(sum(pow((1 + log10(tf)) * idf, 2))) AS norm_value FROM postings JOIN idf USING (term) GROUP BY chunk_id)
"""
_STORED = _CHUNKS + """,
idf AS (SELECT term, arg_max(idf_value, segment_no) AS idf FROM term_index WHERE term IS NOT NULL AND idf_value IS NOT NULL GROUP BY term),
postings AS MATERIALIZED (
  SELECT term, p.chunk_id AS chunk_id, max(p.tf) AS tf FROM (SELECT term, unnest(postings) AS p FROM term_index WHERE term IS NOT NULL)
  WHERE p.chunk_id IS NOT NULL AND p.tf IS NOT NULL GROUP BY term, p.chunk_id),
norms AS (SELECT chunk_id, max(norm_value) AS norm_value FROM doc_norms WHERE norm_value IS NOT NULL GROUP BY chunk_id)
"""
_ASK = """,
asked AS (
  SELECT query_id, term, count(*) AS tf, min(pos) AS pos FROM (
    SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT query_id, {tokens} AS t FROM ({queries})))
  GROUP BY query_id, term),
vector AS MATERIALIZED (
  SELECT query_id, term, pos, idf, (1 + log10(tf)) * idf AS weight, count(*) OVER (PARTITION BY query_id) AS n_terms,
    sqrt(sum(pow((1 + log10(tf)) * idf, 2)) OVER (PARTITION BY query_id)) AS query_norm
  FROM asked JOIN idf USING (term)),
dots AS (
  SELECT query_id, chunk_id, sum(weight * (1 + log10(tf)) * vector.idf) AS dot, count(*) AS matched, min(pos) AS first_pos, any_value(n_terms) AS n_terms,
    any_value(query_norm) AS query_norm
  FROM postings JOIN vector USING (term) GROUP BY query_id, chunk_id),
scores AS MATERIALIZED (
  SELECT query_id, chunk_id, round(dot / (query_norm * norm_value), 9) AS cosine, matched / n_terms AS coverage,
    round(dot / (query_norm * norm_value) * (matched / n_terms), 9) AS rank_key, first_pos
  FROM dots JOIN norms USING (chunk_id) WHERE norm_value > 0 AND query_norm > 0),
best AS (
  SELECT * FROM (
    SELECT s.*, document_id, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank_key DESC, first_pos, s.chunk_id) AS r
    FROM scores s JOIN chunks c ON s.chunk_id = c.chunk_id WHERE document_id IS NOT NULL) WHERE r = 1),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank_key DESC, first_pos, chunk_id) AS INTEGER) AS place FROM best)
"""


def _ask(text: str) -> str:
    return _ASK.format(tokens=_TOKENS.format("text"), queries=f"SELECT CAST(0 AS BIGINT) AS query_id, '{text}' AS text")


def _search(text: str, base: str = _BOOK) -> str:
    return base + _ask(text) + """SELECT place, t.document_id, t.chunk_id, title, artist, round(cosine, 6) AS score, round(coverage, 6) AS coverage,
  round(rank_key, 6) AS rank_key, text FROM top t JOIN chunks c ON t.chunk_id = c.chunk_id WHERE place <= 10"""


_LINES = f"regexp_split_to_array(text, '\\r\\n|[{LINE_ENDS}]')"
_PARAGRAPHS = f"regexp_split_to_array(array_to_string(list_transform({_LINES}, lambda x: regexp_replace(x, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')), chr(10)), '\\n\\n+')"
SQL = {
    "text_chunks": f"""
WITH parts AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter({_PARAGRAPHS}, lambda x: replace(x, chr(10), '') <> '') AS p FROM documents WHERE text IS NOT NULL)),
clean AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, replace(trim(piece, chr(10)), chr(10), ' ') AS chunk FROM parts)
SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, doc_id, pos, chunk FROM clean WHERE len({_TOKENS.format("chunk")}) > 0""",
    "text_tokens": _CHUNKS + "SELECT chunk_id, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_terms, array_to_string(tokens, ' ') AS tokens FROM tokened",
    "term_cf_df": _CHUNKS + "SELECT term, cf, df FROM stats",
    "codebook_topk": _BOOK + "SELECT term, rank FROM book",
    "idf_table": _BOOK + "SELECT term, round(idf, 6) AS idf FROM idf",
    "collection_stats": _CHUNKS + """SELECT (SELECT count(*) FROM tokened) AS n_chunks, (SELECT count(*) FROM stats) AS n_terms, (SELECT count(*) FROM flat) AS n_tokens,
  (SELECT count(DISTINCT document_id) FROM chunks) AS n_documents""",
    "postings_flat": _BOOK + "SELECT term, chunk_id, tf FROM postings",
    "postings_packed": _BOOK + """SELECT term, CAST(floor(chunk_id / 10000) AS BIGINT) AS segment, CAST(count(*) AS INTEGER) AS df,
  string_agg(chunk_id || ':' || tf, ' ' ORDER BY chunk_id) AS postings FROM postings GROUP BY term, segment""",
    "doc_norms_built": _BOOK + "SELECT chunk_id, round(norm_value, 6) AS norm_value FROM norms",
    "query_vector": _BOOK + _ask(REPEATED + " " + UNKNOWN_WORDS) + "SELECT term, round(weight, 6) AS weight, round(query_norm, 6) AS query_norm, n_terms FROM vector",
    "text_scores_all": _BOOK + _ask(QUERY) + "SELECT chunk_id, round(cosine, 6) AS cosine, round(coverage, 6) AS coverage, round(rank_key, 6) AS rank_key FROM scores",
    "text_search_topk": _search(QUERY),
    "text_search_repeat_terms": _search(REPEATED),
    "text_search_oov": _search(UNKNOWN_WORDS),
    "text_search_unknown": _search(ONLY_UNKNOWN),
    "text_search_empty": _search(EMPTY),
    "batch_text_search": _BOOK
    + _ASK.format(tokens=_TOKENS.format("text"), queries="SELECT item_id AS query_id, any_value(text) AS text FROM benchmark WHERE text IS NOT NULL GROUP BY item_id")
    + "SELECT query_id, place, document_id, chunk_id, round(rank_key, 6) AS rank_key FROM top WHERE place <= 5",
    "term_index_lookup": _STORED + _ask(QUERY) + """SELECT term, round(any_value(vector.idf), 6) AS idf, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf
FROM postings JOIN vector USING (term) GROUP BY term""",
    "stored_index_search": _STORED + _ask(QUERY) + """SELECT place, t.document_id, t.chunk_id, title, artist, round(rank_key, 6) AS rank_key
FROM top t JOIN chunks c ON t.chunk_id = c.chunk_id WHERE place <= 10""",
    "index_json_roundtrip": _STORED + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term",
}
