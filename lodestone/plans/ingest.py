"""Dump pages and harvested records, written as XML from documents and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import harvest, wiki_dump
from lodestone.plans.corpus import table


def _escaped(c):
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit("<page><title>T"), number, F.lit("</title><ns>"), (F.col("doc_id") % 2).cast("string"), F.lit("</ns><id>"), number,
        F.lit("</id><revision><id>"), F.when(F.col("doc_id") % 10 == 4, "").otherwise(number),
        F.lit("</id><timestamp>2026-01-01T00:00:00Z</timestamp><text>"), _escaped(F.coalesce("text", F.lit(""))), F.lit("</text></revision></page>"),
    )
    pages = wiki_dump.parsed(d, xml)
    return wiki_dump.articles(pages).select("page_id", "title", "revision_id", "timestamp", F.md5("text_content").alias("text_md5"))


def harvested_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit("<record><header"), F.when(F.col("doc_id") % 9 == 2, ' status="deleted"').otherwise(""), F.lit("><datestamp>2026-01-0"),
        (F.col("doc_id") % 9 + 1).cast("string"), F.lit("</datestamp></header><metadata><arXiv><id>"), number, F.lit("</id><created>2025-12-31</created><title> A  "),
        F.col("source"), F.lit(" </title><authors><author><keyname>K"), number, F.lit("</keyname><forenames>F</forenames></author><author><keyname>"), F.col("lang"),
        F.lit("</keyname></author></authors><categories>"), F.col("lang"), F.lit(" x.y</categories><doi> </doi><abstract>"),
        _escaped(F.coalesce("text", F.lit(""))), F.lit("</abstract></arXiv></metadata></record>"),
    )
    records = harvest.parsed(d, xml)
    out = harvest.papers(records)
    return out.select("id", "oai_datestamp", "title", F.array_join("authors", ", ").alias("authors"), "primary_category", "doi", F.md5("abstract").alias("abstract_md5"))


QUERIES = {f.__name__: f for f in (dump_pages, harvested_papers)}
ORACLE_SQL = {
    "dump_pages": """SELECT doc_id AS page_id, 'T' || doc_id AS title, doc_id AS revision_id, '2026-01-01T00:00:00Z' AS timestamp, md5(coalesce(text, '')) AS text_md5
FROM documents WHERE doc_id % 2 = 0 AND doc_id % 10 <> 4""",
    "harvested_papers": r"""SELECT doc_id::VARCHAR AS id, '2026-01-0' || (doc_id % 9 + 1) AS oai_datestamp, 'A ' || source AS title, 'F K' || doc_id || ', ' || lang AS authors, lang AS primary_category, NULL::VARCHAR AS doi,
md5(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'))) AS abstract_md5 FROM documents WHERE doc_id % 9 <> 2""",
}
