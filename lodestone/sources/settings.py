"""Small tables of names and values: read one, set some, and a dimension that stays what it was first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.merges import upsert
from lodestone.sources.publish import _Files, publish, restore

SCHEMA = "key string, value string"


def settings(spark: SparkSession, path: str) -> DataFrame:
    restore(spark, path)
    return spark.read.schema(SCHEMA).parquet(path) if _Files(spark, path).exists(path) else spark.createDataFrame([], SCHEMA)


def get(spark: SparkSession, path: str, key: str) -> str | None:
    row = settings(spark, path).filter(F.col("key") == key).select("value").first()
    return None if row is None else row.value


def put(spark: SparkSession, path: str, values: dict[str, str]) -> None:
    publish(upsert(settings(spark, path), spark.createDataFrame(list(values.items()), SCHEMA), "key").coalesce(1), path)


def fix_dimension(spark: SparkSession, path: str, dimension: int) -> None:
    """Record the dimension of a corpus's vectors when it is first written; ValueError for another one later."""
    known = get(spark, path, "embedding_dim")
    if known is None:
        put(spark, path, {"embedding_dim": str(dimension)})
    elif int(known) != dimension:
        raise ValueError(f"vectors have {dimension} components, the corpus has {known}")
