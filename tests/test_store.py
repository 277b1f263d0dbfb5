"""Versioned tables: commits over several tables, merges when read, compaction, columns that are added, lost races."""

import random
import threading

import pytest

from lodestone.sources.store import Conflict, Store

pytestmark = pytest.mark.usefixtures("few")
SCHEMA = "k bigint, v string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def with_table(spark, folder, data=()):
    store = Store(spark, folder)
    change = store.begin()
    change.create("t", frame(spark, []).schema, ["k"], 8)
    change.append("t", frame(spark, list(data)))
    change.commit()
    return store


def test_random_changes(spark, tmp_path):
    """Upserts, deletes and compactions against a dictionary."""
    rng = random.Random(3)
    store = with_table(spark, str(tmp_path), [(k, "0") for k in range(40)])
    wanted = {k: "0" for k in range(40)}
    for n in range(1, 9):
        change = store.begin()
        new = {rng.randrange(60): f"v{n}" for _ in range(6)}
        gone = {rng.randrange(60) for _ in range(4)} - set(new)
        change.delete("t", frame(spark, [(k,) for k in gone], "k bigint"))
        change.upsert("t", frame(spark, list(new.items())))
        change.values["n"] = n
        change.commit()
        wanted = {k: v for k, v in wanted.items() if k not in gone} | new
        assert rows(store.read("t")) == sorted(wanted.items(), key=repr)
        if n % 3 == 0:
            store.compact("t", every=n == 6)
            assert rows(store.read("t")) == sorted(wanted.items(), key=repr)
            assert n != 6 or len(store.version().tables["t"]["rows"]) == 1
    assert store.version().values == {"n": 8}
    assert len(store.vacuum()) > 0 and rows(store.read("t")) == sorted(wanted.items(), key=repr)


def test_old_versions_and_broken_writers(spark, tmp_path):
    store = with_table(spark, str(tmp_path), [(1, "a")])
    old = store.version()
    change = store.begin()
    change.upsert("t", frame(spark, [(1, "b"), (None, "n")]))
    assert rows(store.read("t")) == [(1, "a")]  # written, not committed
    change.commit()
    assert rows(store.read("t")) == [(1, "b"), (None, "n")] and rows(store.read("t", old)) == [(1, "a")]
    lost = store.begin()
    lost.append("t", frame(spark, [(9, "lost")]))
    change = store.begin()
    change.upsert("t", frame(spark, [(None, "m")]))
    change.commit()
    with pytest.raises(Conflict):
        lost.commit()
    assert rows(store.read("t")) == [(1, "b"), (None, "m")]
    assert len(store.vacuum(keep=9)) == 1  # the part of the writer that lost
    with pytest.raises(LookupError):
        store.read("none")
    change = store.begin()
    change.clear("t")
    change.commit()
    assert store.read("t").columns == ["k", "v"] and store.read("t").count() == 0


def test_one_of_many_writers_wins(spark, tmp_path):
    """Writers that meet at one version: each commit is there once, none is lost."""
    store = with_table(spark, str(tmp_path))
    start = threading.Barrier(4)

    def write(n):
        def work(change):
            change.append("t", frame(spark, [(n, "w")]))
            change.values[f"w{n}"] = change.seq

        start.wait()
        Store(spark, str(tmp_path)).transact(work)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(store.read("t")) == [(n, "w") for n in range(4)]
    assert sorted(store.version().values.values()) == [2, 3, 4, 5]


def test_added_columns(spark, tmp_path):
    store = with_table(spark, str(tmp_path), [(1, "a"), (2, "b")])
    change = store.begin()
    change.add_column("t", "n", "int", "7")
    change.upsert("t", frame(spark, [(2, "c", None), (3, "d", 1)], "k bigint, v string, n int"))
    change.commit()
    wanted = [(1, "a", 7), (2, "c", None), (3, "d", 1)]
    assert rows(store.read("t")) == wanted
    store.compact("t", every=True)
    assert rows(store.read("t")) == wanted
    change = store.begin()
    with pytest.raises(ValueError):
        change.add_column("t", "v", "string")


def test_only_touched_buckets_are_compared(spark, tmp_path):
    """A small change is a small part, and no other bucket meets a join."""
    store = with_table(spark, str(tmp_path), [(k, "x" * 200) for k in range(4000)])
    before = size(tmp_path)
    change = store.begin()
    change.upsert("t", frame(spark, [(5, "y")]))
    change.commit()
    assert size(tmp_path) - before < 0.2 * before
    assert len(store.version().tables["t"]["deletes"][0]["buckets"]) == 1
    assert store.read("t").count() == 4000 and rows(store.read("t").filter("k = 5")) == [(5, "y")]
    assert len(store.compact("t")) == 1 and store.compact("t") == []
    assert store.read("t").count() == 4000


def size(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))
