"""Inputs that the named queries derive from the test tables, for Spark and as SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import index as I
from lodestone.operators import links as L
from lodestone.operators import vectors as V
from lodestone.scratch import cut, shared_folder
from lodestone.sources.publish import _Files

_built: dict[tuple[str, str, str], tuple[str, object]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _state(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """What the files of the tables are just now: names, sizes and times of change."""
    files = _Files(spark, sf_dir)
    found = []
    for name in [f for t in tables for f in table(spark, sf_dir, t).inputFiles()]:
        status = files.fs.getFileStatus(files.at(name))
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def built_once(spark: SparkSession, sf_dir: str, name: str, build, tables: list[str] | None = None):
    """What `build()` gives, made once for each application and state of the tables; the stored tables of a corpus.

    Where a table's files have changed it is made anew.
    """
    at = (spark.sparkContext.applicationId, sf_dir, name)
    state = _state(spark, sf_dir, tables or ["documents"])
    if at not in _built or _built[at][0] != state:
        _built[at] = (state, build())
    return _built[at][1]


def _index(spark: SparkSession, sf_dir: str, name: str, source: str, key: str, text: Column, kind: str = "words") -> str:
    """The path of a stored index over a text of a table, written when it is first asked for."""

    def build() -> str:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        I.write(table(spark, sf_dir, source), path, key, text, kind=kind)
        return path

    return built_once(spark, sf_dir, name, build, [source])


def part_names(spark: SparkSession, sf_dir: str) -> str:
    """A trigram index over the names of parts, which stand for titles."""
    return _index(spark, sf_dir, "names", "part", "p_partkey", F.col("p_name"), "trigrams")


def packed_vectors(spark: SparkSession, sf_dir: str) -> str:
    """The path of the stored vectors, packed and in clusters."""

    def build() -> str:
        path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        V.write(table(spark, sf_dir, "embeddings"), path, "vec_id", F.col("embedding"))
        return path

    return built_once(spark, sf_dir, "vectors", build, ["embeddings"])


def documents_index(spark: SparkSession, sf_dir: str) -> str:
    return _index(spark, sf_dir, "index", "documents", "doc_id", F.col("text"))


def papers_index(spark: SparkSession, sf_dir: str) -> str:
    """Documents as papers: title, abstract and categories in one text."""
    return _index(spark, sf_dir, "papers", "documents", "doc_id", X.paper_prompt(F.col("source"), F.coalesce("text", F.lit("")), F.col("lang")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, pos): the stored link table of the articles."""
    return built_once(spark, sf_dir, "edges", lambda: cut(L.edges(articles(spark, sf_dir))))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, revision_id, redirect_to, is_redirect): the articles without their texts, stored."""
    narrow = lambda: cut(L.with_redirects(articles(spark, sf_dir)).select("page_id", "title", "revision_id", "redirect_to", "is_redirect"))
    return built_once(spark, sf_dir, "titles", narrow)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, revision_id, text): documents as pages that link and redirect to each other."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
        (F.col("doc_id") * 10 + F.col("doc_id") % 3).alias("revision_id"),
        F.expr(
            """CASE WHEN doc_id % 7 = 3 THEN concat('#REDIRECT [[t', doc_id div 2, '#part]]')
            ELSE concat('[[t', doc_id div 2, ']] [[T', doc_id div 3, '#sec|label]] [[File:x.png|thumb]] [[t', doc_id + 1,
                        ']] [[ t', doc_id div 2, ' ]] [[Category: C', doc_id % 5, ' |k]]\n== S', doc_id % 4, ' ==\n', coalesce(text, '')) END"""
        ).alias("text"),
    )


ARTICLES = """articles AS (SELECT doc_id AS page_id, 'T' || doc_id AS title, doc_id * 10 + doc_id % 3 AS revision_id,
  CASE WHEN doc_id % 7 = 3 THEN '#REDIRECT [[t' || (doc_id // 2) || '#part]]'
  ELSE '[[t' || (doc_id // 2) || ']] [[T' || (doc_id // 3) || '#sec|label]] [[File:x.png|thumb]] [[t' || (doc_id + 1)
    || ']] [[ t' || (doc_id // 2) || ' ]] [[Category: C' || (doc_id % 5) || ' |k]]' || chr(10) || '== S' || (doc_id % 4) || ' ==' || chr(10) || coalesce(text, '') END AS text
  FROM documents),
linked AS (SELECT *, regexp_matches(text, '(?i)^\\s*#\\s*REDIRECT\\s*\\[\\[') AS is_redirect,
  CASE WHEN regexp_matches(text, '(?i)^\\s*#\\s*REDIRECT\\s*\\[\\[') THEN
    upper(substr(regexp_extract(text, '\\[\\[([^\\]|#]+)', 1), 1, 1)) || substr(regexp_extract(text, '\\[\\[([^\\]|#]+)', 1), 2) END AS redirect_to
  FROM articles),
raw AS (SELECT title AS src, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]|\\n#]+)', 1)) AS x,
  generate_subscripts(regexp_extract_all(text, '\\[\\[([^\\[\\]|\\n#]+)', 1), 1) AS i FROM linked WHERE NOT is_redirect),
good AS (SELECT src, upper(substr(trim(x), 1, 1)) || substr(trim(x), 2) AS dst, i FROM raw),
edges AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY min(i)) - 1 AS pos FROM good
  WHERE dst <> src AND NOT (dst LIKE 'File:%' OR dst LIKE 'Category:%') GROUP BY src, dst)"""

#: title -> the article at the end of its redirects, up to five hops
RESOLVED = """chain AS (SELECT title, title AS at, 0 AS hop FROM linked
  UNION ALL SELECT c.title, l.redirect_to, c.hop + 1 FROM chain c JOIN linked l ON l.title = c.at WHERE l.redirect_to IS NOT NULL AND c.hop < 5),
resolved AS (SELECT c.title, c.at AS resolved FROM chain c JOIN linked l ON l.title = c.at AND l.redirect_to IS NULL)"""
EMBEDDED = "embedded AS (SELECT 'T' || doc_id AS title, doc_id * 10 + doc_id % 2 AS revision_id, doc_id AS page_id FROM labels)"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, revision_id, page_id): labelled documents count as embedded at some revision."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"),
        (F.col("doc_id") * 10 + F.col("doc_id") % 2).alias("revision_id"),
        F.col("doc_id").alias("page_id"),
    )
