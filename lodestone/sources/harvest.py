"""Harvested paper records (OAI-PMH): cached response pages and their projection to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lodestone.functions.text import collapse_white_space

_AUTHOR = StructType([StructField("keyname", StringType()), StructField("forenames", StringType())])
_PAPER = StructType(
    [
        *(StructField(n, StringType()) for n in ("id", "created", "updated", "title", "categories", "comments", "doi", "journal-ref", "abstract")),
        StructField("authors", StructType([StructField("author", ArrayType(_AUTHOR))])),
    ]
)
RECORD = StructType(
    [
        StructField("header", StructType([StructField("_status", StringType()), StructField("identifier", StringType()), StructField("datestamp", StringType())])),
        StructField("metadata", StructType([StructField("arXiv", _PAPER)])),
    ]
)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Records of cached response pages with `seq`, an order by file name and place."""
    rows = spark.read.format("xml").option("rowTag", "record").option("mode", "DROPMALFORMED").schema(RECORD).load(path)
    return rows.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at")).alias("seq"))


def parsed(df: DataFrame, xml: Column) -> DataFrame:
    """Records of a column with one record element in each row; read once, by a generator."""
    return df.select(F.inline(F.array(F.from_xml(xml, RECORD))))


def papers(records: DataFrame) -> DataFrame:
    """Records as papers; deleted ones and those without header or metadata are dropped. Blank optional fields are null."""
    p = lambda n: F.col(f"metadata.arXiv.`{n}`")
    optional = lambda n: F.nullif(F.trim(p(n)), F.lit(""))
    names = F.transform(
        F.coalesce(F.col("metadata.arXiv.authors.author"), F.array().cast(ArrayType(_AUTHOR))),
        lambda a: F.trim(F.concat_ws(" ", F.nullif(F.trim(a["forenames"]), F.lit("")), F.nullif(F.trim(a["keyname"]), F.lit("")))),
    )
    kept = F.col("header").isNotNull() & F.col("metadata.arXiv").isNotNull() & (F.coalesce("header._status", F.lit("")) != "deleted")
    return records.filter(kept).select(
        F.trim(p("id")).alias("id"), F.col("header.datestamp").alias("oai_datestamp"),
        collapse_white_space(p("title")).alias("title"), collapse_white_space(p("abstract")).alias("abstract"),
        F.filter(names, lambda x: x != "").alias("authors"), F.trim(p("categories")).alias("categories"),
        F.substring_index(F.trim(p("categories")), " ", 1).alias("primary_category"), F.trim(p("created")).alias("submitted_date"),
        optional("updated").alias("updated_date"), optional("doi").alias("doi"), optional("journal-ref").alias("journal_ref"), optional("comments").alias("comments"),
    )
