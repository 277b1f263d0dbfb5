"""Corpora as folders of tables: what there is, how it is opened, and scans in the order of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.presence import may_have
from lodestone.sources.publish import _Files, restore


def table_path(base: str, corpus: str, name: str) -> str:
    return f"{base}/{corpus}/{name}"


def corpora(spark: SparkSession, base: str, name: str) -> list[str]:
    """The corpora below `base` that have the table `name`, sorted."""
    found = _Files(spark, base).like(f"{base}/*/{name}")
    return sorted({path.rstrip("/").rsplit("/", 2)[1] for path in found} - {"_presence"})


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at `path`; one whose last swap broke off is put back first."""
    restore(spark, path)
    return _Files(spark, path).exists(path)


def open_path(spark: SparkSession, path: str) -> DataFrame:
    if not has_table(spark, path):
        raise FileNotFoundError(f"there is no table at {path}")
    return spark.read.parquet(path)


def open_table(spark: SparkSession, base: str, corpus: str, name: str) -> DataFrame:
    """A corpus's table; FileNotFoundError if there is none."""
    return open_path(spark, table_path(base, corpus, name))


def ordered_scan(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows in the order of `key`, the first `limit` of them if it is given."""
    return df.orderBy(key) if limit is None else df.orderBy(key).limit(limit)


def corpus_info(spark: SparkSession, base: str, corpus: str, settings: dict[str, str], embedded: str = "articles_meta") -> dict[str, object]:
    """A corpus's name, its settings (model, dimension, limits) and how many rows of the table `embedded` it has; none if it is missing."""
    try:
        count = open_table(spark, base, corpus, embedded).count()
    except FileNotFoundError:
        count = 0
    return {"corpus": corpus, **settings, "embedded": count}


def corpora_with(spark: SparkSession, base: str, name: str, column: str, value: str) -> list[str]:
    """The corpora whose table `name` has a row with `value` in `column`.

    Filters beside the tables say which corpora may have it; those, and corpora without a
    filter, are asked together in one job, each by a condition that its files prune.
    """
    known = corpora(spark, base, name)
    filtered = {p.rstrip("/").rsplit("corpus=", 1)[1] for p in _Files(spark, base).like(f"{base}/_presence/{name}.{column}/corpus=*")}
    values = spark.range(1).select(F.lit(value).alias("value"))
    maybe = {r.corpus for r in may_have(spark, base, name, column, values).collect()} if filtered else set()
    asked = [c for c in known if c in maybe or c not in filtered]
    rows = None
    for c in asked:
        one = open_table(spark, base, c, name).filter(F.col(column) == value).limit(1).select(F.lit(c).alias("corpus"))
        rows = one if rows is None else rows.unionByName(one)
    return sorted(r.corpus for r in rows.collect()) if rows is not None else []
