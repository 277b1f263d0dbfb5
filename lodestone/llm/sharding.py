"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled within their source by a seeded hash of id and extra columns (size and
checksum, so that rows of one id or of none are spread too) and ranked there; the
fractional rank (rank - 1/2) / (rows of the source) spreads each source evenly over
[0, 1). All rows are then ordered by fractional rank and cut into runs whose sizes
differ by at most one, so each shard holds every source in proportion.

No rank is taken over one large group. The hash splits a source into buckets, and
the fractional rank splits the whole table; rows are numbered inside a bucket and
the bucket's start is added, which comes from a table of counts. The number of
buckets follows the number of rows.

Defined results: a null source is a source of its own; a null text has size 8 and
the checksum of the empty text; repeated rows each get a place of their own; of
rows that agree in id, size and checksum it does not matter which comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import cut, text_or_empty


def _bucket_bits(n_rows: int, rows_per_bucket: int) -> int:
    return max(10, (max(1, n_rows) // rows_per_bucket).bit_length())


def _starts(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds `start`, the rows of earlier buckets, and `total`; `counts` has one row for each bucket."""
    whole = W.partitionBy(*by)
    before = whole.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(
        *by, order, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("total")
    )


def interleave(
    df: DataFrame,
    n_shards: int,
    key: str = "doc_id",
    stratum: str = "source",
    extra: dict[str, Column] | None = None,
    seed: int = 20,
    rows_per_bucket: int = 200_000,
) -> DataFrame:
    """(key, the columns of `extra`, shard int, slot long), one row for each row of `df`.

    `extra` names computed columns to carry along; they also break ties of the
    shuffle. The rows are counted first, so `df` is read three times, twice without
    the columns that only `extra` needs.
    """
    extra = extra or {}
    n_rows = df.count()
    bits = _bucket_bits(n_rows, rows_per_bucket)
    shuffled = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), *extra.values()), 1)
    base = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("_stratum"),
        shuffled.alias("_hash"),
        F.shiftright(shuffled, 63 - bits).cast("int").alias("_bucket"),
        *(c.alias(f"_x_{name}") for name, c in extra.items()),
    )
    carried = [f"_x_{name}" for name in extra]

    counts = base.groupBy("_stratum", "_bucket").agg(F.count("*").alias("n"))
    starts = cut(_starts(counts, ["_stratum"], "_bucket"))
    within = W.partitionBy("_stratum", "_bucket").orderBy("_hash", "_key", *carried)
    rank = F.col("start") + F.row_number().over(within)
    ranked = cut(
        base.join(starts, ["_stratum", "_bucket"])
        .withColumn("_fraction", (rank - 0.5) / F.col("total"))
        .select("_key", "_stratum", "_hash", "_fraction", *carried)
    )

    buckets = 1 << bits
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_fraction") * buckets).cast("int"))
    counts = ranked.groupBy("_bucket").agg(F.count("*").alias("n"))
    starts = cut(_starts(counts, [], "_bucket"))
    within = W.partitionBy("_bucket").orderBy("_fraction", "_stratum", "_hash", "_key", *carried)
    place = F.col("start") + F.row_number().over(within) - 1
    exact = F.expr(f"(_place * {n_shards}) div {max(1, n_rows)}")
    first = F.expr(f"(shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
    return (
        ranked.join(starts, "_bucket")
        .withColumn("_place", place)
        .withColumn("shard", exact.cast("int"))
        .select(
            F.col("_key").alias(key),
            *(F.col(f"_x_{name}").alias(name) for name in extra),
            "shard",
            (F.col("_place") - first).cast("long").alias("slot"),
        )
    )


def size_and_checksum(text: str = "text") -> dict[str, Column]:
    """The UTF-8 bytes of a text plus 8, and its unsigned crc32."""
    value = text_or_empty(text)
    return {
        "size": (F.octet_length(value) + 8).cast("long"),
        "text_crc32": F.crc32(value.cast("binary")).cast("long"),
    }
