"""Search queries: BM25, vectors, fusion, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import tokens as T
from lodestone.operators import index as I
from lodestone.operators import retrieval as R
from lodestone.operators import vectors as V
from lodestone.plans.corpus import documents_index, packed_vectors, part_names, table

TERMS = ["the", "of", "der"]
QUERY = [((i * 37) % 64 - 31.5) / 200 for i in range(64)]
_POINT = "[" + ", ".join(repr(x) for x in QUERY) + "]::DOUBLE[]"
#: A hundred points, as a formula of their number and place.
POINTS = [[((i * 37 + q * 11) % 64 - 31.5) / (150 + q) for i in range(64)] for q in range(100)]
_TOKENS = r"tok AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\x{80}-\x{10FFFF}]+') IF x <> ''] AS w FROM documents)"


def _bm25_sql(terms: list[str], match: str) -> str:
    tf = ", ".join(f"len([x FOR x IN w IF x = '{t}']) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df{i} + 0.5) / (df{i} + 0.5)) END)"
    part = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    where = f" {match} ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{_TOKENS}, cnt AS (SELECT doc_id, len(w) AS len, {tf} FROM tok),
st AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM cnt),
bm AS (SELECT doc_id, {part} AS score FROM cnt, st WHERE {where})"""


def _found(spark: SparkSession, sf_dir: str, terms: list[str], all_terms: bool = True) -> DataFrame:
    """(doc_id, score) from the stored index: only the files of the terms are read."""
    return I.search(spark, documents_index(spark, sf_dir), [[t] for t in terms], all_terms).withColumnRenamed("key", "doc_id")


def _best(spark: SparkSession, sf_dir: str, terms: list[str], k: int) -> DataFrame:
    """(doc_id, score) of the k best documents; blocks that cannot reach them are not scored."""
    return I.top(spark, documents_index(spark, sf_dir), [[t] for t in terms], k).withColumnRenamed("key", "doc_id")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, TERMS[:2], 50).select("doc_id", F.round("score", 6).alias("score"))


def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _found(spark, sf_dir, TERMS, all_terms=False)
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = R.corpus_stats(table(spark, sf_dir, "documents"), F.col("text"))
    return stats.select("n_docs", F.round("mean_length", 6).alias("mean_length"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frequencies(spark, documents_index(spark, sf_dir))


def stemmed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct tokens are counted first, so each is stemmed once
    tokens = I.frequencies(spark, documents_index(spark, sf_dir))
    return tokens.groupBy(T.porter("term").alias("stem")).agg(F.sum("cf").alias("cf"), F.count("*").alias("n_words"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.dense(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), QUERY, 50)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


def dense_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of a hundred points at once, from packed vectors by clusters."""
    near = V.nearest(spark, packed_vectors(spark, sf_dir), POINTS, 10)
    return near.select("query", F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits = R.hybrid(_best(spark, sf_dir, TERMS[:2], 50), "doc_id", vectors, F.col("embedding"), QUERY, top_k=10)
    return hits.select("doc_id", F.round("score", 9).alias("score"), "rank")


def sparse_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.hybrid(_found(spark, sf_dir, TERMS[:2]), "doc_id", None, None, None, top_k=20, sparse_order="rowid")
    return hits.select("doc_id", F.round("score", 9).alias("score"), "rank")


def hydrated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    search = lambda q: I.top(spark, documents_index(spark, sf_dir), q, 50).withColumnRenamed("key", "doc_id")
    meta = documents.select("doc_id", "source", "lang", "n_chars")
    hits, _ = R.retrieve(" ".join(TERMS[:2]), search, "doc_id", vectors, F.col("embedding"), lambda _: QUERY, meta, top_k=10)
    return hits.select("doc_id", F.round("score", 9).alias("score"), "rank", "source", "lang", "n_chars")


def hits_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    hits = _found(spark, sf_dir, TERMS[:1]).join(documents.select("doc_id", "source"), "doc_id")
    hits = hits.withColumn("score", F.round("score", 6))
    return R.per_group(hits, "source", 2, F.desc("score"), "doc_id")


def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the stored trigram index; the names are read for the hits only."""
    hits = I.phrase_search(spark, part_names(spark, sf_dir), "RED").withColumnRenamed("key", "p_partkey")
    named = hits.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    return named.select("p_partkey", "p_name", F.round("score", 6).alias("score"))


def title_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index: every name is read."""
    hits = R.title_search(table(spark, sf_dir, "part"), "p_partkey", "p_name", "RED")
    return hits.select("p_partkey", "p_name", F.round("score", 6).alias("score"))


def title_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return customers.filter(X.like_prefix(F.col("c_name"), "customer#00000")).select("c_custkey", "c_name")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    section = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return d.select(
        "doc_id",
        F.md5(X.document_prompt(F.col("source"), section, F.coalesce("text", F.lit("")))).alias("prompt_md5"),
        F.md5(X.paper_prompt(F.col("source"), F.coalesce("text", F.lit("")), F.col("lang"))).alias("paper_md5"),
        X.query_prompt(F.col("source")).alias("query"),
    )


def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    vector = R.hashed_embedding(F.regexp_replace("html", "<[^>]*>", " "), 16)
    checked = R.one_dimension(pages.select("page_id", vector.alias("embedding")), "embedding", 16)
    return checked.select("page_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


def corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy(F.col("source").alias("corpus")).agg(F.count("quality").alias("embedded"), F.count("*").alias("articles"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_all, corpus_stats, document_frequency, stemmed_frequency, dense_topk, dense_many, rrf_hybrid, sparse_only,
        hydrated_hits, hits_per_source, title_search, title_scan, title_prefix, prompts, hashed_embeddings, corpus_info,
    )
}

_FUSED = f"""sp AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 50)),
dn AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY d, vec_id) AS r FROM
  (SELECT vec_id, list_distance(embedding::DOUBLE[], {_POINT}) AS d FROM embeddings ORDER BY d, vec_id LIMIT 50)),
al AS (SELECT doc_id, r, 0 AS arm FROM dn UNION ALL SELECT doc_id, r, 1 FROM sp),
fu AS (SELECT doc_id, sum(1.0::DOUBLE / (60 + r)) AS s, min(arm * 1000 + r) AS f FROM al GROUP BY doc_id),
top AS (SELECT doc_id, s, row_number() OVER (ORDER BY s DESC, f) AS rank FROM fu ORDER BY s DESC, f LIMIT 10)"""
_RRF = f"{_bm25_sql(TERMS[:2], 'AND')}, {_FUSED}"

ORACLE_SQL = {
    "bm25_topk": f"WITH {_bm25_sql(TERMS[:2], 'AND')} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 50",
    "bm25_all": f"WITH {_bm25_sql(TERMS, 'OR')} SELECT doc_id, round(score, 6) AS score FROM bm",
    "corpus_stats": f"WITH {_TOKENS} SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS mean_length FROM tok",
    "document_frequency": f"WITH {_TOKENS}, u AS (SELECT doc_id, unnest(w) AS term FROM tok) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM u GROUP BY term",
    "dense_topk": f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {_POINT}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {_POINT}), vec_id LIMIT 50",
    "dense_many": """WITH q AS (SELECT query::INT AS query, [((i * 37 + query * 11) % 64 - 31.5)::DOUBLE / (150 + query) FOR i IN range(64)] AS p FROM range(100) t(query))
SELECT query, vec_id, round(d, 6) AS distance, rank FROM (SELECT query, vec_id, d, row_number() OVER (PARTITION BY query ORDER BY d, vec_id)::INT AS rank
FROM (SELECT query, vec_id, list_distance(embedding::DOUBLE[], p) AS d FROM q, embeddings)) WHERE rank <= 10""",
    "rrf_hybrid": f"WITH {_RRF} SELECT doc_id, round(s, 9) AS score, rank FROM top",
    "hydrated_hits": f"WITH {_RRF} SELECT doc_id, round(s, 9) AS score, rank, source, lang, n_chars FROM top JOIN documents USING (doc_id)",
    "sparse_only": f"WITH {_bm25_sql(TERMS[:2], 'AND')}, sp AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM bm) SELECT doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank FROM sp WHERE rank <= 20",
    "hits_per_source": f"WITH {_bm25_sql(TERMS[:1], 'AND')}, h AS (SELECT doc_id, source, round(score, 6) AS score FROM bm JOIN documents USING (doc_id)) SELECT doc_id, source, score FROM h QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) <= 2",
    "title_search": """WITH c AS (SELECT p_partkey, p_name, greatest(length(p_name) - 2, 0) AS len, (length(lower(p_name)) - length(replace(lower(p_name), 'red', ''))) / 3.0::DOUBLE AS tf FROM part),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (tf > 0) AS df FROM c)
SELECT p_partkey, p_name, round((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score
FROM c, s WHERE tf > 0 ORDER BY (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) DESC, p_partkey LIMIT 20""",
    "title_prefix": "SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE 'customer#00000%'",
    "prompts": """SELECT doc_id, md5('search_document: ' || source || CASE WHEN doc_id % 2 = 0 AND lang <> '' THEN ' - ' || lang ELSE '' END || chr(10) || chr(10) || coalesce(text, '')) AS prompt_md5,
md5(source || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Categories: ' || lang) AS paper_md5, 'search_query: ' || source AS query FROM documents""",
    "corpus_info": "SELECT source AS corpus, count(quality) AS embedded, count(*) AS articles FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1",
}
ORACLE_SQL["title_scan"] = ORACLE_SQL["title_search"]
