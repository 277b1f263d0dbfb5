"""The stateful queue against the tables of `enqueue`, for shuffled and repeated batches, restarts and timers."""

import datetime
import random

import pytest
from lodestone.operators import queue as Q
from lodestone.streaming import queue as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    old, parts = spark.conf.get(PROVIDER), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(PROVIDER, old)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


START = datetime.datetime(2026, 1, 1)


def write(spark, rows, folder, minute=0):
    spark.createDataFrame([(*r, START + datetime.timedelta(minutes=minute)) for r in rows], S.EVENT).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, patience=600_000):
    events = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    S.queue_stream(events, str(tmp_path / "store"), str(tmp_path / "cp"), patience).awaitTermination()
    return sorted(tuple(r) for r in S.items(spark, str(tmp_path / "store")).collect())


def test_requests_merge_in_any_order(rocks, tmp_path):
    """Shuffled, repeated requests over several batches and a restart between them, against one merge of all."""
    rng = random.Random(1)
    asked = [(rng.randrange(2), f"T{rng.randrange(6)}", "ask", None, rng.randrange(4), rng.randrange(2), 0) for _ in range(40)]
    batches = [asked[:15], asked[15:30], rng.sample(asked, 20), asked[30:]]
    for b in batches[:2]:
        write(rocks, rng.sample(b, len(b)), str(tmp_path / "events"))
    run(rocks, tmp_path)
    for b in batches[2:]:
        write(rocks, rng.sample(b, len(b)), str(tmp_path / "events"))
    got = run(rocks, tmp_path)
    nothing = rocks.createDataFrame([], S.ITEM)
    new = rocks.createDataFrame([(j, t, h, f) for j, t, _, _, h, f, _ in asked], "job_id bigint, title string, hops_remaining int, force int")
    assert got == sorted(tuple(r) for r in Q.enqueue(nothing, new).select("job_id", "title", "status", "hops_remaining", "force").collect())
    # an item that has moved on keeps its own; reports of older numbers come too late
    write(rocks, [(0, "X", "ask", None, 1, 0, 0), (0, "X", "report", "complete", None, None, 5)], str(tmp_path / "events"))
    write(rocks, [(0, "X", "ask", None, 3, 1, 0), (0, "X", "report", "in_progress", None, None, 4)], str(tmp_path / "events"))
    assert (0, "X", "complete", 1, 0) in run(rocks, tmp_path)


def test_items_that_stay_in_progress(rocks, tmp_path):
    """Without a report they go back to the queue when their time is over; with one they don't."""
    events = str(tmp_path / "events")
    write(rocks, [(1, t, "ask", None, 0, 0, 0) for t in "AB"] + [(1, t, "report", "in_progress", None, None, 1) for t in "AB"], events)
    assert {r[2] for r in run(rocks, tmp_path)} == {"in_progress"}
    write(rocks, [(1, "B", "report", "complete", None, None, 2)], events, 5)
    write(rocks, [(2, "C", "ask", None, 0, 0, 0)], events, 200)
    run(rocks, tmp_path)
    write(rocks, [(2, "D", "ask", None, 0, 0, 0)], events, 201)
    got = {r[1]: r[2] for r in run(rocks, tmp_path)}
    assert got == {"A": "queued", "B": "complete", "C": "queued", "D": "queued"}
