"""Pages of wiki XML dumps, compressed or not, and the newest dump of a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_TEXT = StructType([StructField("_VALUE", StringType()), StructField("_bytes", StringType())])
_USER = StructType([StructField("username", StringType()), StructField("id", StringType())])
_REVISION = StructType(
    [
        StructField("id", StringType()), StructField("parentid", StringType()), StructField("timestamp", StringType()),
        StructField("contributor", _USER), StructField("comment", StringType()), StructField("text", _TEXT),
    ]
)
#: Numbers are read as text and cast afterwards, so that a bad number drops a page and not the file.
PAGE = StructType(
    [StructField("title", StringType()), StructField("ns", StringType()), StructField("id", StringType()), StructField("revision", _REVISION)]
)
ARTICLE = StructType(
    [
        StructField("page_id", LongType()), StructField("title", StringType()), StructField("namespace", LongType()),
        StructField("revision_id", LongType()), StructField("parent_revision_id", LongType()), StructField("timestamp", StringType()),
        StructField("contributor_username", StringType()), StructField("contributor_id", LongType()), StructField("comment", StringType()),
        StructField("text_bytes", LongType()), StructField("text_content", StringType()),
    ]
)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages of dumps at `path`; a page cut off at the end of a file is dropped, and so is what follows a damaged block."""
    return (
        spark.read.format("xml").option("rowTag", "page").option("mode", "DROPMALFORMED").option("ignoreSurroundingSpaces", "false")
        .option("ignoreCorruptFiles", "true").schema(PAGE).load(path)
    )


def articles(pages: DataFrame, namespace: int | None = 0) -> DataFrame:
    """Pages as articles: rows without title, ids, namespace, revision or a text element are dropped, and rows with numbers that are none."""
    number = lambda name: F.expr(f"try_cast(trim({name}) AS BIGINT)")
    present = lambda c: F.col(c).isNull() | number(c).isNotNull()
    text = F.coalesce(F.col("revision.text._VALUE"), F.lit(""))
    good = (
        (F.trim(F.coalesce("title", F.lit(""))) != "") & number("id").isNotNull() & number("ns").isNotNull()
        & number("revision.id").isNotNull() & F.col("revision.text").isNotNull()
        & present("revision.parentid") & present("revision.contributor.id") & present("revision.text._bytes")
    )
    out = pages.filter(good).select(
        number("id").alias("page_id"), "title", number("ns").alias("namespace"), number("revision.id").alias("revision_id"),
        number("revision.parentid").alias("parent_revision_id"), F.coalesce("revision.timestamp", F.lit("")).alias("timestamp"),
        F.col("revision.contributor.username").alias("contributor_username"), number("revision.contributor.id").alias("contributor_id"),
        F.col("revision.comment").alias("comment"), F.coalesce(number("revision.text._bytes"), F.octet_length(text).cast("long")).alias("text_bytes"),
        text.alias("text_content"),
    )
    return out if namespace is None else out.filter(F.col("namespace") == namespace)


def parsed(df: DataFrame, xml: Column) -> DataFrame:
    """Raw pages of a column with one page element in each row, for dumps that arrive as records.

    The element is read by a generator: a projection would be copied into each of the
    conditions and columns above it, and the page parsed again for every one.
    """
    return df.select(F.inline(F.array(F.from_xml(xml, PAGE, {"ignoreSurroundingSpaces": "false"}))))


def latest_dump(spark: SparkSession, folder: str, corpus: str) -> str:
    """The newest dump of a corpus below `folder`: multistream before monolithic before unfinished ones. Any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for pattern in ("*pages-articles-multistream*.xml*.bz2", "*pages-articles*.xml.bz2", "*pages-articles*.tmp"):
        found = files.globStatus(jvm.org.apache.hadoop.fs.Path(base, f"{corpus}-{pattern}"))
        names = sorted((f.getPath().toString() for f in found or []), reverse=True)
        if names:
            return names[0]
    raise FileNotFoundError(f"{folder} has no dump of {corpus}")
