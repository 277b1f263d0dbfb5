"""Tables that are written once to the folder all executors share, and read back."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class _Scopes(threading.local):
    """The open scopes of a thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_scopes = _Scopes()


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; where that is unset a temporary one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Lineage ends there, so a lost executor never repeats what stands above, and
    a side that several joins use is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lodestone-{uuid.uuid4().hex}"
    if _scopes.open:
        _scopes.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end all tables that `cut` writes inside, in this thread: for work whose result has been written by then."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for path in _scopes.open.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a `cut()` result that nothing reads any more."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("lodestone-"):
            _delete(df.sparkSession, folder)
