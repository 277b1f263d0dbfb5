"""Embedding jobs, paper search and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import embedding as E
from lodestone.operators import index as I
from lodestone.operators import retrieval as R
from lodestone.plans.corpus import articles, embedded, papers_index, table
from lodestone.plans.search import _FUSED, _TOKENS, QUERY

DIMENSION = 8


def embed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.embed_articles(articles(spark, sf_dir), embedded(spark, sf_dir), DIMENSION)
    return out.select("page_id", "section", "chunk_index", "text_length", F.size("embedding").alias("dimension"))


def embedded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recorded as embedded after the job: every article but redirects, at its revision."""
    meta = embedded(spark, sf_dir)
    chunks = E.embed_articles(articles(spark, sf_dir), meta, DIMENSION)
    return E.new_meta(meta, chunks).select("page_id", "revision_id")


def embed_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 10 != 3, F.col("html")).alias("html"))
    return E.embed_papers(papers, F.col("html"), DIMENSION)[0].select("id", "status")


def embed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, meta = articles(spark, sf_dir), embedded(spark, sf_dir)
    return E.embed_counts(pages, meta, E.embed_articles(pages, meta, DIMENSION)).select("new", "updated", "skipped", "failed")


def embed_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    stamp = F.concat(F.lit("2026-01-0"), (F.col("doc_id") % 3 + 1).cast("string"))
    papers = d.select(F.col("doc_id").alias("id"), stamp.alias("oai_datestamp"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("abstract"), F.col("lang").alias("categories"))
    meta = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.concat(F.lit("2026-01-0"), (F.col("doc_id") % 2 + 1).cast("string")).alias("oai_datestamp"))
    return E.embed_abstracts(papers, meta, DIMENSION).select("id", "state", F.size("embedding").alias("dimension"))


PAPER_QUERY = "the \"of-the\" ?"


def _paper_hits(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return I.search(spark, papers_index(spark, sf_dir), query).withColumnRenamed("key", "doc_id")


def _paper_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.to_json(F.array("source", "lang")).alias("authors"))
    return d.withColumn("authors", F.array_join(F.from_json("authors", "array<string>"), " "))


def paper_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _paper_hits(spark, sf_dir, PAPER_QUERY).orderBy(F.desc("score"), "doc_id").limit(20)
    return hits.join(_paper_meta(spark, sf_dir), "doc_id").select("doc_id", F.round("score", 6).alias("score"), "source", "authors")


def paper_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and vectors for a free query over papers, hydrated with their authors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    hits, _ = R.retrieve(PAPER_QUERY, lambda q: I.top(spark, papers_index(spark, sf_dir), q, 50).withColumnRenamed("key", "doc_id"), "doc_id", vectors, F.col("embedding"), lambda _: QUERY, _paper_meta(spark, sf_dir), top_k=20)
    return hits.select("doc_id", F.round("score", 9).alias("score"), "rank", "authors")


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count("*").alias("articles"), F.max("doc_id").alias("last_id"), F.count_if(F.col("text").isNull()).alias("without_text"),
        F.round(F.avg(F.char_length("text")), 6).alias("mean_chars"),
    )


QUERIES = {f.__name__: f for f in (embed_articles, embedded_pages, embed_papers, embed_counts, embed_abstracts, paper_search, paper_retrieve, verify_report)}
_PAPERS = f"""p AS (SELECT doc_id, source || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Categories: ' || lang AS text FROM documents),
{_TOKENS.replace('FROM documents', 'FROM p')}, c AS (SELECT doc_id, len(w) AS len, len([x FOR x IN w IF x = 'the']) AS a,
  len([x FOR x IN list_zip(w, w[2:]) IF x[1] = 'of' AND x[2] = 'the']) AS b FROM tok),
s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
g AS (SELECT doc_id, greatest(CASE WHEN da * 2 >= n THEN 1e-6 ELSE ln((n - da + 0.5) / (da + 0.5)) END, 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / mean))
  + greatest(CASE WHEN db * 2 >= n THEN 1e-6 ELSE ln((n - db + 0.5) / (db + 0.5)) END, 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / mean)) AS score FROM c, s WHERE a > 0 AND b > 0)"""

ORACLE_SQL = {
    "embed_counts": """WITH s AS (SELECT d.doc_id % 7 = 3 AS redirect, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id % 3 = d.doc_id % 2 THEN 'skipped' ELSE 'updated' END AS state
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) SELECT count(*) FILTER (state = 'new' AND NOT redirect) AS new, count(*) FILTER (state = 'updated' AND NOT redirect) AS updated,
count(*) FILTER (state = 'skipped') AS skipped, count(*) FILTER (state <> 'skipped' AND redirect) AS failed FROM s""",
    "embed_abstracts": """SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'new' ELSE 'updated' END AS state, 8 AS dimension
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR d.doc_id % 3 <> d.doc_id % 2""",
    "embedded_pages": """SELECT doc_id AS page_id, CASE WHEN doc_id % 7 = 3 THEN doc_id * 10 + doc_id % 2 ELSE doc_id * 10 + doc_id % 3 END AS revision_id
FROM documents WHERE doc_id % 7 <> 3 OR doc_id IN (SELECT doc_id FROM labels)""",
    "embed_papers": "SELECT page_id AS id, CASE WHEN page_id % 10 = 3 THEN 'no_html' ELSE 'embedded' END AS status FROM pages",
    "paper_search": f"WITH {_PAPERS} SELECT doc_id, round(score, 6) AS score, source, source || ' ' || lang AS authors FROM g JOIN documents USING (doc_id) ORDER BY g.score DESC, doc_id LIMIT 20",
    "paper_retrieve": f"""WITH {_PAPERS}, {_FUSED.replace('bm ', 'g ').replace('LIMIT 10', 'LIMIT 20')}
SELECT doc_id, round(s, 9) AS score, rank, source || ' ' || lang AS authors FROM top JOIN documents USING (doc_id)""",
    "verify_report": "SELECT lang, count(*) AS articles, max(doc_id) AS last_id, count(*) FILTER (text IS NULL) AS without_text, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY lang",
}
