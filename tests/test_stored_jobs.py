"""Indexes, embedding jobs, refreshes and queues in versioned tables: crashes, races, deltas."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import embedding as E
from lodestone.operators import index as I
from lodestone.operators import queue as Q
from lodestone.operators import retrieval as R
from lodestone.sources.store import Store, Transaction
from lodestone.streaming.refresh import merge_batch, refresh_stream

pytestmark = pytest.mark.usefixtures("few")
PAGES = "page_id bigint, title string, revision_id bigint, text string"


def tables(spark, folder, names):
    store = Store(spark, folder)
    at = store.version()
    return {n: sorted((tuple(r) for r in store.read(n, at).collect()), key=repr) for n in names if n in at.tables}


def words(spark, folder, query):
    return {r.key for r in I.search(spark, folder, query).collect()}


class Crash(Exception):
    pass


def crash_at(monkeypatch, step):
    """Writers break off before they put their `step`-th part, or the version, in its place."""
    count = iter(range(1000))

    def broken(real):
        def run(*given, **named):
            if next(count) == step:
                raise Crash
            return real(*given, **named)

        return run

    monkeypatch.setattr(Transaction, "_write", broken(Transaction._write))
    monkeypatch.setattr(Transaction, "commit", broken(Transaction.commit))
    return count


def test_embedding_job_breaks_off_anywhere(spark, tmp_path, monkeypatch):
    """After a crash at every step the old state is there, whole; the job that is tried again gives the new one, with no stale posting."""
    folder = str(tmp_path / "s")
    page = "\n".join(f"== S{k} ==\nalpha{k} beta" for k in range(3))
    old = {1: ("A", 1, page), 2: ("B", 1, "gamma delta"), 3: ("R", 1, "#REDIRECT [[A]]")}
    new = old | {1: ("A", 2, "only words"), 4: ("D", 1, "delta")}
    frame = lambda pages: spark.createDataFrame([(k, *v) for k, v in pages.items()], PAGES)
    state = lambda: (tables(spark, folder, ["chunks", "articles_meta", "index_lengths"]), words(spark, folder, "alpha2"), words(spark, folder, "delta"))
    assert E.run_embedding(spark, frame(old), folder, 8) == {"new": 2, "updated": 0, "skipped": 0, "failed": 0, "empty": 1, "chunks": 4}
    before = state()
    assert len(before[1]) == 1 and len(before[2]) == 1
    steps = 0
    while True:
        with monkeypatch.context() as m:
            crash_at(m, steps)
            try:
                counts = E.run_embedding(spark, frame(new), folder, 8)
                break
            except Crash:
                steps += 1
        assert state() == before
    assert steps > 6 and counts == {"new": 1, "updated": 1, "skipped": 2, "failed": 0, "empty": 0, "chunks": 2}
    after = state()
    assert not after[1] and after[2] == {"2-0-0", "4-0-0"}
    assert {r[0] for r in after[0]["articles_meta"]} == {1, 2, 3, 4}
    assert E.run_embedding(spark, frame(new), folder, 8)["skipped"] == 4
    E.forget_pages(spark, folder, spark.createDataFrame([(2,)], "page_id bigint"))
    assert words(spark, folder, "delta") == {"4-0-0"} and {r[0] for r in tables(spark, folder, ["articles_meta"])["articles_meta"]} == {1, 3, 4}
    with pytest.raises(ValueError):
        E.run_embedding(spark, frame({}) if False else spark.createDataFrame([], PAGES), folder, 16)


def test_failed_embeddings_are_done_again(spark, tmp_path):
    bad = lambda text, dimension: F.when(~text.contains("poison"), R.hashed_embedding(text, dimension))
    articles = spark.createDataFrame([(1, "A", 1, "good"), (2, "B", 1, "poison")], PAGES)
    folder = str(tmp_path / "s")
    assert E.run_embedding(spark, articles, folder, 8, bad) == {"new": 1, "updated": 0, "skipped": 0, "failed": 1, "empty": 0, "chunks": 1}
    assert E.run_embedding(spark, articles, folder, 8)["new"] == 1
    papers = spark.createDataFrame([("a", "<p>fine</p>"), ("b", "<p>poison</p>"), ("c", None)], "id string, html string")
    run = lambda embed: E.run_papers(spark, papers, F.col("html"), folder, 8, embed)
    assert run(bad) == {"embedded": 1, "failed": 1, "no_html": 1}
    assert {r[0]: r[1] for r in tables(spark, folder, ["papers"])["papers"]} == {"a": "embedded", "b": "failed", "c": "no_html"}
    assert run(R.hashed_embedding) == {"embedded": 1}
    assert sorted(r[0] for r in tables(spark, folder, ["paper_chunks"])["paper_chunks"]) == ["a", "b"]


def test_two_calls_start_one_job(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    jobs = spark.createDataFrame([(1, "w", "queued", 0, None), (2, "w", "queued", 0, None), (3, "v", "running", 0, None), (4, "v", "queued", 0, None)], "job_id int, corpus string, status string, cancel_requested int, started_at string")
    change = store.begin()
    change.create("jobs", jobs.schema, ["job_id"])
    change.append("jobs", jobs)
    change.commit()
    started, together = [], threading.Barrier(3)

    def call(n):
        together.wait()
        started.extend((n, r.job_id) for r in Q.start_next(Store(spark, str(tmp_path)), F.lit(f"t{n}")).collect())

    threads = [threading.Thread(target=call, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [j for _, j in started] == [1]
    got = {r.job_id: (r.status, r.started_at) for r in store.read("jobs").collect()}
    assert got == {1: ("running", f"t{started[0][0]}"), 2: ("queued", None), 3: ("running", None), 4: ("queued", None)}


def test_refresh_stream(spark, tmp_path, monkeypatch):
    """Batches that break off or are tried again leave each row and each archived row once."""
    schema = "page_id bigint, revision_id bigint, body string, seq bigint"
    folder, feed = str(tmp_path / "s"), str(tmp_path / "feed")
    start = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 5, "c")], "page_id bigint, revision_id bigint, body string")
    change = Store(spark, folder).begin()
    change.create("articles", start.schema, ["page_id"])
    change.append("articles", start)
    change.commit()
    rows = [(1, 1, "skip", 1), (2, 2, "first", 2), (2, 3, "last", 3), (3, 4, "older", 4), (9, 1, "new", 5)]
    spark.createDataFrame(rows, schema).write.parquet(feed)
    run = lambda: refresh_stream(spark, feed, spark.read.parquet(feed).schema, folder, str(tmp_path / "cp")).awaitTermination()
    for step in (0, 2):
        with monkeypatch.context() as m:
            crash_at(m, step)
            with pytest.raises(Exception):
                run()
        assert len(tables(spark, folder, ["articles"])["articles"]) == 3
    for again in (False, False, True):
        if again:  # the batch ended, but Spark did not get to note it
            for name in ("0", ".0.crc"):
                (tmp_path / "cp" / "commits" / name).unlink()
        run()
        got = tables(spark, folder, ["articles", "archive"])
        assert got == {"articles": [(1, 1, "a"), (2, 3, "last"), (3, 4, "older"), (9, 1, "new")], "archive": [(2, 1, "b"), (3, 5, "c")]}


def test_a_small_feed_writes_little(spark, tmp_path):
    """A feed of 0.1 % writes under 1 % of the bytes; columns that are kept survive."""
    folder = tmp_path / "s"
    store = Store(spark, str(folder))
    pages = spark.range(20_000).selectExpr("id AS page_id", "1L AS revision_id", "concat_ws(' ', transform(sequence(1, 60), i -> sha1(concat(id, '-', i)))) AS body", "id AS created")
    change = store.begin()
    change.create("articles", pages.schema, ["page_id"], 8)
    change.append("articles", pages)
    change.commit()
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    feed = spark.range(10).selectExpr("id * 1999 AS page_id", "2L AS revision_id", "'new' AS body", "-1L AS created").unionByName(spark.range(10).selectExpr("id * 1999 + 1 AS page_id", "1L AS revision_id", "'skip' AS body", "-1L AS created"))
    counts = store.transact(lambda tx: merge_batch(tx, feed, "articles", None, kept=["created"]))
    assert counts == {"inserted": 0, "updated": 10, "skipped": 10}
    assert size() - before < 0.01 * before
    got = {r.page_id: r.created for r in store.read("articles").filter("body = 'new'").collect()}
    assert got == {k * 1999: k * 1999 for k in range(10)} and store.read("articles").count() == 20_000


def scores(df):
    return {r.key: round(r.score, 9) for r in df.collect()}


def test_index_changes(spark, tmp_path):
    """Segments that replace and remove documents, and the index written anew, against an index of what is left."""
    schema = "id bigint, t string"
    texts = {1: "a b c", 2: "a a d", 3: "b d", 4: None, 5: ""}
    path, fresh = str(tmp_path / "i"), iter(range(10))

    def same():
        other = str(tmp_path / f"f{next(fresh)}")
        I.write(spark.createDataFrame(list(texts.items()), schema), other, "id", F.col("t"), buckets=1)
        for query in ("b d", "a-b"):
            assert scores(I.search(spark, path, query)) == scores(I.search(spark, other, query)), query
        assert scores(I.top(spark, path, "d", 2)) == scores(I.top(spark, other, "d", 2))
        assert sorted(map(tuple, I.frequencies(spark, path).collect())) == sorted(map(tuple, I.frequencies(spark, other).collect()))

    I.write(spark.createDataFrame(list(texts.items()), schema), path, "id", F.col("t"))
    texts |= {2: "b b", 6: "a b d d"}
    I.write(spark.createDataFrame([(k, texts[k]) for k in (2, 6)], schema), path, "id", F.col("t"))
    same()
    I.delete(spark, path, spark.createDataFrame([(1,), (77,)], "id bigint"))
    texts.pop(1)
    same()
    I.compact(spark, path)
    same()
    texts[9] = "a z"
    I.write(spark.createDataFrame([(9, "a z")], schema), path, "id", F.col("t"))
    same()
    with pytest.raises(LookupError):
        I.search(spark, str(tmp_path / "none"), "a")


def test_best_documents_without_all_postings(spark, tmp_path):
    """`top` equals the whole search for any query, and decodes few postings for a rare and a frequent term."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(3000):
        n = rng.choice([5, 20, 60])
        rows.append((k, " ".join(["the"] * rng.randrange(0, 4) + [vocabulary[min(59, int(rng.expovariate(0.15)))] for _ in range(n)] + ["rare"] * (k in (700, 701, 2222)))))
    path = str(tmp_path / "i")
    I.write(spark.createDataFrame(rows, "id bigint, t string").repartition(4), path, "id", F.col("t"))
    for query, all_terms in (("the rare", True), ("the w3", True), ("w1 w40", False), ("the the w2 rare", False), ("w59", True), ("none the", True), ("none the", False)):
        wanted = sorted(((-s, k) for k, s in scores(I.search(spark, path, query, all_terms)).items()))[:10]
        got = [(-round(r.score, 9), r.key) for r in I.top(spark, path, query, 10, all_terms).collect()]
        assert got == wanted, query
    report = {}
    assert I.top(spark, path, "the rare", 10, report=report).count() == I.search(spark, path, "the rare").count() > 0
    assert 0 < report["decoded"] < 0.5 * report["postings"] and report["blocks"] <= 3
    phrase = spark.createDataFrame([(1, "a-b a b"), (2, "b a"), (3, "a b")], "id bigint, t string")
    other = str(tmp_path / "p")
    I.write(phrase, other, "id", F.col("t"))
    assert set(scores(I.top(spark, other, "a-b", 5))) == {1, 3}


def test_frontier_bounds_every_document():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (1, 5, 64, 500):
        for rows in (1, 3, n):
            for _ in range(20):
                row = np.sort(rng.integers(0, rows, n))
                row = np.unique(row, return_inverse=True)[1]
                tf, length = rng.integers(1, 30, n), rng.integers(1, 200, n)
                found = I._frontier(row, tf, length)
                for k in range(row.max() + 1):
                    pairs = [(a, b) for r, a, b in zip(*map(np.ndarray.tolist, found), strict=True) if r == k]
                    here = list(zip(tf[row == k].tolist(), length[row == k].tolist(), strict=True))
                    assert 0 < len(pairs) <= I.FRONTIER
                    assert all(any(a >= t and b <= x for a, b in pairs) for t, x in here)
                    if len(pairs) < I.FRONTIER:
                        assert set(pairs) <= set(here)


def test_index_reads_only_the_terms(spark, tmp_path):
    path = str(tmp_path / "i")
    I.write(spark.createDataFrame([(k, f"word{k} common") for k in range(500)], "id bigint, t string"), path, "id", F.col("t"), buckets=16)
    plan = I.terms(spark, path, ["word7"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[-1]
    # bounds and frequencies come from the narrow columns
    plan = I.frequencies(spark, path)._jdf.queryExecution().toString()
    assert "positions" not in plan.split("ReadSchema")[-1] and "docs" not in plan.split("ReadSchema")[-1]
    assert sorted(r.key for r in I.terms(spark, path, ["word7", "word9"]).collect()) == [7, 9]


def test_phrases_by_trigrams(spark, tmp_path):
    """The stored trigram index against the scan of every title: overlaps, repeats, case, absent grams."""
    rng = random.Random(9)
    titles = ["".join(rng.choice("aAbB c") for _ in range(rng.randrange(0, 14))) for _ in range(300)] + ["aaaaaaa", "ab", "", "Zürich zürich", None]
    df = spark.createDataFrame(list(enumerate(titles)), "id bigint, t string")
    path = str(tmp_path / "i")
    I.write(df.fillna("", "t"), path, "id", F.col("t"), kind="trigrams")
    for query in ("aab", "AAA", "aaaa", "b c", "ürich", "abcabc", "zzz"):
        wanted = [(r.id, round(r.score, 9)) for r in R.title_search(df.fillna("", "t"), "id", "t", query).collect()]
        assert [(r.key, round(r.score, 9)) for r in I.phrase_search(spark, path, query).collect()] == wanted, query
    with pytest.raises(ValueError):
        I.phrase_search(spark, path, "ab")


def test_index_rows_are_shuffled_packed(spark, sf_dir, tmp_path, monkeypatch):
    """A few packed rows for each task and folder go through the shuffle, and every posting arrives once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(2, "doc_id").sortWithinPartitions("doc_id")
    moved, write = [], Transaction._write
    monkeypatch.setattr(Transaction, "_write", lambda self, table, kind, df, *a: (moved.append(df.count()) if table == "index_postings" else None, write(self, table, kind, df, *a))[1])
    I.write(docs, str(tmp_path), "doc_id", F.col("text"), buckets=4)
    wanted = {(w.decode(), r.doc_id) for r in docs.collect() for w in I.words_of((r.text or "").encode())}
    found = [(r.term, r.key) for r in I.terms(spark, str(tmp_path)).select("term", "key").collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    assert moved[0] <= 4 * 2 * spark.sparkContext.defaultParallelism < len(wanted) / 100


def test_index_of_the_older_hash(few, tmp_path):
    """Folders by xxhash64, as indexes were written before: they are read, take more documents and can be written anew."""
    path = str(tmp_path)
    store = Store(few, path)

    def begin(tx):
        I.add(tx, few.createDataFrame([], "id bigint, t string"), "id", F.col("t"), buckets=4)
        del tx.values["index_hash"]

    store.transact(begin)
    assert "index_hash" not in store.version().values
    I.write(few.createDataFrame([(1, "a b c d e f"), (2, "b f g")], "id bigint, t string"), path, "id", F.col("t"))
    I.write(few.createDataFrame([(2, "a g h"), (3, "h b")], "id bigint, t string"), path, "id", F.col("t"))
    for _ in range(2):
        assert {t: {r.key for r in I.search(few, path, t).collect()} for t in "abfgh"} == {"a": {1, 2}, "b": {1, 3}, "f": {1}, "g": {2}, "h": {2, 3}}
        I.compact(few, path)


def test_index_of_documents_in_another_file_system(few, tmp_path):
    few.createDataFrame([(1, "a b"), (2, "b c")], "id bigint, t string").write.parquet(str(tmp_path / "in" / "d"))
    few.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}/in")
    I.write(few.read.parquet("viewfs://other/in/d"), str(tmp_path / "i"), "id", F.col("t"))
    assert {r.key for r in I.search(few, str(tmp_path / "i"), "b").collect()} == {1, 2}
