"""Revision-aware refresh, upserts, deletes and archives as joins of old and new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def last_wins(feed: DataFrame, key: str, order: Column | str, *then: Column | str) -> DataFrame:
    """One row of each key, the last by `order`; where several are last, the first of them by `then`."""
    newest = W.partitionBy(key).orderBy(F.desc(order), *then)
    return feed.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")


def refresh_actions(target: DataFrame, feed: DataFrame, key: str = "page_id", revision: str = "revision_id") -> DataFrame:
    """`feed` with `action`: insert where the key is new, skip where the revision is equal, update where it differs, even if older."""
    old = target.select(F.col(key).alias("_k"), F.col(revision).alias("_rev"))
    same = F.col(revision) == F.col("_rev")
    action = F.when(F.col("_k").isNull(), "insert").when(same, "skip").otherwise("update")
    return feed.join(old, feed[key] == old["_k"], "left").withColumn("action", action).drop("_k", "_rev")


def with_kept(old: DataFrame, changed: DataFrame, schema: StructType, key: str, kept: list[str]) -> DataFrame:
    """Rows of `changed` (a feed with `action`) with the columns of `schema`; an update has those of `kept`, and those that the feed lacks, from its row in `old`."""
    own = [f.name for f in schema if f.name != key and (f.name in kept or f.name not in changed.columns)]
    before = old.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_o_{c}") for c in own))
    rows = changed.join(before, F.col(key) == F.col("_k"), "left") if own else changed
    update = F.col("action") == "update"
    fresh = lambda c: F.col(c) if c in changed.columns else F.lit(None).cast(schema[c].dataType)
    return rows.select(*(F.when(update, F.col(f"_o_{f.name}")).otherwise(fresh(f.name)).alias(f.name) if f.name in own else F.col(f.name) for f in schema))


def refresh(target: DataFrame, feed: DataFrame, key: str = "page_id", revision: str = "revision_id", kept: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new target, rows to archive). Pages absent from the feed stay; columns of `kept` survive an update; old rows of updates are archived.

    What changes is found from keys and revisions alone; rows of the target that stay are
    only passed on, and a feed that is small against it is broadcast by its keys.
    """
    changed = refresh_actions(target, feed, key, revision).filter("action <> 'skip'")
    names = changed.select(F.col(key).alias("_k"), "action")
    same = target[key] == F.col("_k")
    merged = target.join(names, same, "left_anti").unionByName(with_kept(target, changed, target.schema, key, kept or []))
    return merged, target.join(names.filter("action = 'update'"), same, "left_semi")


def paper_actions(papers: DataFrame, feed: DataFrame, key: str = "id", stamp: str = "oai_datestamp") -> DataFrame:
    """`feed` with `action`: inserted, updated where the stamp differs either way, skipped where it is equal."""
    renamed = {"insert": "inserted", "update": "updated", "skip": "skipped"}
    acted = refresh_actions(papers, feed, key, stamp)
    names = F.create_map(*(F.lit(x) for pair in renamed.items() for x in pair))
    return acted.withColumn("action", names[F.col("action")])


def counters(acted: DataFrame) -> DataFrame:
    """One row of scanned, skipped, updated, inserted, archived."""
    of = lambda a: F.count_if(F.col("action") == a)
    return acted.agg(
        F.count("*").alias("scanned"), of("skip").alias("skipped"), of("update").alias("updated"),
        of("insert").alias("inserted"), of("update").alias("archived"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` in place of the rows of `old` with its keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def embedded_state(articles: DataFrame, meta: DataFrame, key: str, revision: str) -> DataFrame:
    """`articles` keys with `state`: new, updated or skipped against what has been embedded."""
    acted = refresh_actions(meta, articles.select(key, revision), key, revision)
    return acted.select(key, F.when(F.col("action") == "insert", "new").when(F.col("action") == "skip", "skipped").otherwise("updated").alias("state"))
