"""Refreshes that arrive as files: each batch is merged into a stored table and its old rows are archived."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.operators.merges import last_wins, refresh_actions, with_kept
from lodestone.scratch import cut
from lodestone.sources.store import Store, Transaction


def merge_batch(tx: Transaction, rows: DataFrame, table: str, archive: str | None, key: str = "page_id", revision: str = "revision_id", kept: list[str] | None = None) -> dict[str, int]:
    """Put `rows`, one for each key, into a stored table: counts of inserted, updated and skipped rows.

    Keys and revisions are compared in the buckets that `rows` fall into. What is written is
    the rows that change, the keys they replace and the old rows for the archive; everything
    else stays where it lies.
    """
    known = tx.tables[table]
    own = cut(rows.withColumn("_b", F.pmod(F.xxhash64(F.col(key).cast(tx.read(table).schema[key].dataType)), F.lit(known["buckets"])).cast("int")))
    buckets = [r._b for r in own.select("_b").distinct().collect()]  # at most a table's buckets
    target = tx.read(table, keep=F.col("_bucket").isin(buckets)) if buckets else tx.read(table).limit(0)
    acted = cut(refresh_actions(target, own.drop("_b"), key, revision))
    counts = {r.action: r.n for r in acted.groupBy("action").agg(F.count("*").alias("n")).collect()}
    changed = acted.filter("action <> 'skip'")
    if counts.get("insert", 0) + counts.get("update", 0):
        old = cut(target.join(changed.filter("action = 'update'").select(key), key, "left_semi").select(*target.columns))
        tx.upsert(table, with_kept(old, changed, target.schema, key, kept or []))
        if archive is not None:
            tx.create(archive, target.schema, [key], known["buckets"])
            tx.append(archive, old)
    return {"inserted": counts.get("insert", 0), "updated": counts.get("update", 0), "skipped": counts.get("skip", 0)}


def refresh_stream(
    spark: SparkSession, feed: str, schema: StructType, folder: str, checkpoint: str, table: str = "articles", archive: str | None = "archive",
    key: str = "page_id", revision: str = "revision_id", order: str = "seq", kept: list[str] | None = None,
) -> StreamingQuery:
    """Merges all Parquet files of `feed` that were not merged before into a table of the store `folder`, then ends.

    Table, archive and the number of the batch change in one commit: a batch that is tried
    again finds its number and does nothing, or finds the old table and does all of it.
    """
    mark = "batch-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def merge(batch: DataFrame, number: int) -> None:
        rows = last_wins(batch, key, order)

        def work(tx: Transaction) -> None:
            if tx.values.get(mark, -1) < number:
                merge_batch(tx, rows, table, archive, key, revision, kept)
                tx.values[mark] = number

        Store(batch.sparkSession, folder).transact(work)

    stream = spark.readStream.schema(schema).parquet(feed)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
