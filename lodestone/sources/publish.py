"""Tables that readers see whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Files:
    """Renames and small files on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.at(old), self.at(new))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def touch(self, path: str) -> None:
        self.fs.create(self.at(path), True).close()

    def like(self, pattern: str) -> list[str]:
        return sorted(f.getPath().toString() for f in self.fs.globStatus(self.at(pattern)) or [])


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None, mark: str | None = None) -> None:
    """Write `df` beside `path` and put it in its place; what was there is deleted last, and a failure leaves it as it was.

    With `mark` the new table carries a name that `published` finds, so that a job that
    is tried again knows whether its table is in place.
    """
    spark = df.sparkSession
    files = _Files(spark, path)
    restore(spark, path)
    name = uuid.uuid4().hex
    new, old = f"{path}.new-{name}", f"{path}.old-{name}"
    try:
        writer = df.write
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(new)
        if mark is not None:
            files.touch(f"{new}/_mark-{mark}")
    except Exception:
        files.delete(new)
        raise
    existed = files.exists(path)
    if existed and not files.rename(path, old):
        raise OSError(f"{path} cannot be moved aside")
    if not files.rename(new, path):
        files.rename(old, path)
        raise OSError(f"{new} cannot take the place of {path}")
    if existed:
        files.delete(old)


def published(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether the table at `path` was published with `mark`."""
    return _Files(spark, path).exists(f"{path}/_mark-{mark}")


def restore(spark: SparkSession, path: str) -> None:
    """Put a table back that was moved aside by a `publish` which ended before it had put the new one there."""
    files = _Files(spark, path)
    if not files.exists(path):
        for old in files.like(f"{path}.old-*"):
            files.rename(old, path)
            break


def read_with_defaults(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A table whose older files lack columns: `columns` maps each to the SQL of its default; other columns are dropped."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*(F.coalesce(F.col(c), F.expr(d)).alias(c) if c in df.columns else F.expr(d).alias(c) for c, d in columns.items()))


def reset(spark: SparkSession, path: str) -> None:
    """The table without rows, its columns as they were."""
    publish(spark.read.parquet(path).limit(0), path)


def log_run(spark: SparkSession, path: str, run: dict[str, object], schema: str) -> None:
    """Append one row about a finished run."""
    spark.createDataFrame([tuple(run.values())], schema).toDF(*run).coalesce(1).write.mode("append").parquet(path)


def write_side_files(df: DataFrame, folder: str, name: str, text: str) -> None:
    """The column `text` of each row as a text file below `folder`, one folder `name=...` for each value of the column `name`.

    Folders of other names stay as they are, one of the same name is replaced. Signs that a
    file system does not take are written as codes, so no two names share a folder.
    """
    named = df.filter(F.col(text).isNotNull()).select(F.col(name).cast("string").alias("name"), F.col(text).alias("value"))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(folder)


def read_side_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value) of all side files, whole."""
    return spark.read.schema("value string, name string").text(folder, wholetext=True).select("name", "value")
