"""Shared helpers of the training-data operators: tables, scratch data, Arrow loops."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.scratch import cut, forget, shared_folder  # noqa: F401  the operators take them from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def one_text(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _t): of the rows of equal keys the text of smallest hash, whatever their number and order."""
    least = df.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("t"))).alias("m"))
    return least.select(*keys, F.col("m.t").alias("_t"))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then(value)` with `value` computed once, however often `then` mentions it."""
    return F.transform(F.array(value), then)[0]


def before_each(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: `combine` of zero and all elements before each one, for an associative `combine`.

    Elements are taken in blocks of the root of their number: arrays grown inside a block
    stay short, so n elements cost n ** 1.5 copies of a number and not n ** 2.
    """
    longs = F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), longs.alias("out"))

    def scan(xs: Column, value: Callable[[Column], Column]) -> Column:
        step = lambda s, x: F.struct(combine(s["at"], value(x)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, start, step)

    def whole(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda b: scan(F.slice(v, b * width + 1, width), lambda x: x.cast("bigint"))
        )
        joined = lambda bs: F.zip_with(bs, scan(bs, lambda b: b["at"])["out"], lambda b, st: F.transform(b["out"], lambda o: combine(st, o)))
        return F.when(F.size(v) > 0, F.flatten(bound(blocks, joined))).otherwise(longs)

    return bound(values, whole)


def sums_before(values: Column) -> Column:
    return before_each(values, lambda a, b: a + b)


def highest_before(values: Column) -> Column:
    return before_each(values, lambda a, b: F.greatest(a, b))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few rows, as Arrow: without a Python worker on the executors, which rows of tuples would start."""
    shape = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(shape)
    arrow = to_arrow_schema(shape)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow), shape)


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null stays null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def told_apart(df: DataFrame, hash_: str, check: str) -> DataFrame:
    """`df` without `check`, a second hash of what `hash_` stands for; where contents that differ share a hash, they are told apart by the second.

    Among 10 ** 10 contents a few share 64 bits; two hashes of 128 bits together are not met.
    """
    one = df.groupBy(hash_).agg(F.min(check).alias("_low"), F.max(check).alias("_high")).filter("_low <> _high")
    shared = cut(one.select(hash_, F.lit(True).alias("_shared")))
    if shared.isEmpty():
        return df.drop(check)
    apart = df.join(shared, hash_, "left")
    return apart.withColumn(hash_, F.when(F.col("_shared"), F.col(check)).otherwise(F.col(hash_))).drop("_shared", check)


try:
    _C = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _C = None


def give_back() -> None:
    """Return what a Python worker has freed to the system: Spark keeps the worker for other work, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    if _C is not None:
        _C.malloc_trim(0)


def map_batches(
    df: DataFrame, schema: str, row_batch: Callable[[pa.RecordBatch], dict[str, object]], rows: int = 512
) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows, so that very long texts stay few at a time.

    `row_batch` gets a slice and returns the columns of its result, in schema order.
    """
    ship(df.sparkSession)
    target = StructType.fromDDL(schema)
    names = target.names
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = row_batch(batch.slice(start, rows))
                arrays = [
                    value if isinstance(value, pa.Array) else pa.array(value, type=arrow.field(name).type)
                    for name, value in ((n, out[n]) for n in names)
                ]
                del out
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    return df.mapInArrow(run, target)
