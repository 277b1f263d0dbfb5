"""Making this package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors of this application, once.

    Functions that run in Python workers are pickled by reference, so workers need
    the package; Spark's own file server takes it there as a zip of a few kilobytes.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(rows) and spark.conf.get(rows) == "10000":
        # Spark's default that nobody set; texts are long, so fewer rows travel at a time, which both sides hold in memory
        spark.conf.set(rows, "2000")
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
