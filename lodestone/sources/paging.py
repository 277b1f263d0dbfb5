"""Any page of an ordered table without sorting what stands before it.

A paged table is written once in ranges of its order: every file holds what stands between
two others, sorted. A row for each file, in `_ranges` beside it, tells how many rows it
has. A page adds up these counts, opens the files it falls into, one or two, and sorts
nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.publish import publish


def write_pages(df: DataFrame, path: str, order: list[str], rows_per_file: int = 100_000) -> None:
    """Store `df` for `page`, in the order of the columns `order`; equal rows of them may stand in any order."""
    n = df.count()
    files = max(1, -(-n // rows_per_file))
    ranged = df.repartitionByRange(files, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
    publish(ranged, f"{path}/rows", partition_by=["_range"] if n else None)
    stored = df.sparkSession.read.parquet(f"{path}/rows")
    counts = stored.groupBy("_range").agg(F.count("*").alias("n"))
    # a row for each file, so that one task may add them up
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    publish(counts.withColumn("start", before).coalesce(1), f"{path}/_ranges")


def files_of(spark: SparkSession, path: str, first: int, size: int) -> list[tuple[int, int]]:
    """(number, place of its first row) of the files that hold rows from place `first` to before `first + size`."""
    ranges = spark.read.parquet(f"{path}/_ranges")
    hit = ranges.filter((F.col("start") < first + size) & (F.col("start") + F.col("n") > first))
    return sorted((r._range, r.start) for r in hit.select("_range", "start").collect())


def page(spark: SparkSession, path: str, order: list[str], number: int, size: int) -> DataFrame:
    """Page `number`, from 1, of `size` rows."""
    first = (max(1, number) - 1) * size
    hit = files_of(spark, path, first, size)
    rows = spark.read.parquet(f"{path}/rows")
    found = rows.filter(F.col("_range").isin([n for n, _ in hit])).drop("_range")
    if not hit:
        return found.limit(0)
    return found.orderBy(*order).offset(first - min(start for _, start in hit)).limit(size)
