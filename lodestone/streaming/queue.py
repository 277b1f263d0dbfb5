"""The queue as a stateful stream: requests and reports of items in, the items as they stand out.

Each (job, title) has a state that Spark keeps and checkpoints: status, hops left, force.
Requests for one title merge as in `operators.queue.enqueue`, whatever their order and in
whichever batch they come; a report moves an item on; an item that stays in progress longer
than `patience`, by the times of the events, goes back to the queue by a timer. What has changed in a batch is put into
the table `items` of a store, together with the batch's number, so a batch that is tried
again changes nothing twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.sources.store import Store, Transaction

#: kind: ask (hops_remaining, force) or report (status); seq orders the reports of an item; at is when the event was sent.
EVENT = "job_id bigint, title string, kind string, status string, hops_remaining int, force int, seq bigint, at timestamp"
ITEM = "job_id bigint, title string, status string, hops_remaining int, force int"
_STATE = "status string, hops int, force int, seq bigint"


class _Item(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", _STATE)

    def _row(self, key: tuple, item: tuple) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "title": [key[1]], "status": [item[0]], "hops_remaining": [item[1]], "force": [item[2]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = tuple(self.state.get()) if self.state.exists() else None
        item = known
        events = pd.concat(list(rows))
        asked = events[events.kind == "ask"]
        if len(asked) and (item is None or item[0] == "queued"):
            # all requests of a batch count before its reports, in any order
            hops, force = int(asked.hops_remaining.max()), int(asked.force.max())
            item = ("queued", hops, force, -1) if item is None else (item[0], max(item[1], hops), max(item[2], force), item[3])
        reports = events[events.kind == "report"].sort_values("seq")
        for r in reports.itertuples():
            if item is not None and r.seq > item[3]:
                item = (r.status, item[1], item[2], int(r.seq))
        if item == known or item is None:
            return
        self.state.update(item)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if item[0] == "in_progress":
            self.handle.registerTimer(int(events["at"].max().timestamp() * 1000) + self.patience)
        yield self._row(key, item)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        item = tuple(self.state.get()) if self.state.exists() else None
        if item is not None and item[0] == "in_progress":
            item = ("queued", *item[1:])
            self.state.update(item)
            yield self._row(key, item)

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, folder: str, checkpoint: str, patience_ms: int = 600_000, late: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Runs the stream `events` (EVENT) into the table `items` of the store `folder`: all that is there, or for good.

    Events that come more than `late` behind the newest are dropped. The session needs `spark.sql.streaming.stateStore.providerClass` to be RocksDB's.
    """
    spark = events.sparkSession
    ship(spark)
    shape = StructType.fromDDL(ITEM)
    mark = "queue-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def create(tx: Transaction) -> None:
        tx.create("items", shape, ["job_id", "title"])

    Store(spark, folder).transact(create)

    def put(batch: DataFrame, number: int) -> None:
        def work(tx: Transaction) -> None:
            if tx.values.get(mark, -1) < number:
                tx.upsert("items", batch)
                tx.values[mark] = number

        Store(batch.sparkSession, folder).transact(work)

    timed = events.withWatermark("at", late)
    moved = timed.groupBy("job_id", "title").transformWithStateInPandas(_Item(patience_ms), shape, outputMode="Update", timeMode="EventTime")
    writer = moved.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def items(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, title, status, hops_remaining, force) as they stand."""
    return Store(spark, folder).read("items")
