"""Which corpora may have a value: Bloom filters beside the tables, asked before any table is opened.

A filter is a table of 64-bit words of a bit array whose length is a power of two, as rows
(word, bits) of the words that have a bit. It is made and added to by aggregations that
combine before the shuffle, and a question reads only the words that the value's bits fall
into, of all corpora in one job. A filter never misses a value; with 10 bits for each, as
many as it is made for, 1 % of others pass it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.publish import _Files, publish, restore

HASHES = 7
BITS_EACH = 10


def _folder(base: str, name: str, column: str, corpus: str) -> str:
    return f"{base}/_presence/{name}.{column}/corpus={corpus}"


def _places(value: Column, size: Column) -> Column:
    """The places of a value's bits, by two hashes and their sums."""
    text = value.cast("string")
    one, two = F.xxhash64(text), F.xxhash64(text, F.lit(1))
    return F.array(*(F.pmod(F.shiftrightunsigned(one, 2) + i * F.shiftrightunsigned(two, 6), size) for i in range(HASHES)))


def _words(df: DataFrame, column: str, size: int) -> DataFrame:
    places = df.filter(F.col(column).isNotNull()).select(F.explode(_places(F.col(column), F.lit(size).cast("long"))).alias("p"))
    word = places.select(F.floor(F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("bits"))
    return word.groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumn("size", F.lit(size).cast("long"))


def write_presence(df: DataFrame, base: str, corpus: str, name: str, column: str, expected: int | None = None) -> None:
    """A filter over the values of a column of the table `name` of a corpus, made for `expected` values or twice as many as there are."""
    n = expected or 2 * df.agg(F.approx_count_distinct(column)).first()[0]
    size = 1 << max(10, math.ceil(math.log2(max(1, n) * BITS_EACH)))
    publish(_words(df, column, size).sort("word"), _folder(base, name, column, corpus))


def add_presence(df: DataFrame, base: str, corpus: str, name: str, column: str) -> None:
    """More values for a filter; what it has been made for may be exceeded, then more of others pass."""
    spark, path = df.sparkSession, _folder(base, name, column, corpus)
    restore(spark, path)
    old = spark.read.parquet(path)
    size = old.agg(F.max("size")).first()[0]
    if size is None:  # a filter without a value
        write_presence(df, base, corpus, name, column)
        return
    both = old.unionByName(_words(df, column, size)).groupBy("word").agg(F.bit_or("bits").alias("bits"), F.max("size").alias("size"))
    publish(both.sort("word"), path)


def may_have(spark: SparkSession, base: str, name: str, column: str, values: DataFrame) -> DataFrame:
    """(value, corpus) where the corpus's filter does not exclude the value, for `values` (value), in one job for all corpora."""
    at = f"{base}/_presence/{name}.{column}"
    if not _Files(spark, base).like(f"{at}/corpus=*"):
        return values.select("value", F.lit(None).cast("string").alias("corpus")).limit(0)
    filters = spark.read.schema("word bigint, bits bigint, size bigint, corpus string").parquet(at)
    sizes = filters.groupBy("size").agg(F.collect_set("corpus").alias("corpora"))  # a row for each power of two
    asked = values.select("value").distinct().join(F.broadcast(sizes)).select("value", "size", F.explode("corpora").alias("corpus"), F.array_distinct(_places(F.col("value"), F.col("size"))).alias("places"))
    asked = asked.select("value", "corpus", F.size("places").alias("n"), F.explode("places").alias("p")).withColumn("word", F.floor(F.col("p") / 64).cast("long"))
    met = asked.join(filters.select("corpus", "word", "bits"), ["corpus", "word"])
    bit = F.expr("shiftrightunsigned(bits, CAST(p % 64 AS INT)) & 1L")
    return met.groupBy("value", "corpus").agg(F.sum(bit).alias("set"), F.first("n").alias("n")).filter(F.col("set") == F.col("n")).select("value", "corpus")
