"""Exact nearest vectors by pivots, and link counts by deltas."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import link_counts as C
from lodestone.operators import links as L
from lodestone.operators import retrieval as R
from lodestone.operators import vectors as V
from lodestone.sources.store import Store


def test_nearest_equals_the_scan(spark, sf_dir, tmp_path):
    """100 queries against the distances of all vectors; clusters are skipped, bytes come back as they were."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    V.write(df, str(tmp_path), "vec_id", F.col("embedding"))
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    names, x = np.array(list(rows)), np.stack(list(rows.values()))
    rng = np.random.default_rng(4)
    queries = x[rng.integers(0, len(x), 100)] + rng.standard_normal((100, x.shape[1])) * 0.01
    report = {}
    got = {}
    for r in V.nearest(spark, str(tmp_path), queries.tolist(), 10, report=report).collect():
        got.setdefault(r.query, []).append((r.rank, r.key, r.distance))
    for q in range(100):
        d = np.sqrt(((x - queries[q]) ** 2).sum(axis=1))
        wanted = sorted(zip(d.tolist(), names.tolist(), strict=True))[:10]
        assert [k for _, k, _ in sorted(got[q])] == [k for _, k in wanted]
        assert np.allclose([v for *_, v in sorted(got[q])], [v for v, _ in wanted], rtol=1e-12)
    assert report["vectors"] == len(x) and report["clusters"] <= report["of"] and report["compared"] <= 100 * len(x)
    one = [(r.vec_id, r.distance) for r in R.dense(df, "vec_id", F.col("embedding"), queries[0].tolist(), 10).collect()]
    assert [k for k, _ in one] == [k for _, k, _ in sorted(got[0])]
    back = {r.key: r.vector for r in V.vectors(spark, str(tmp_path)).collect()}
    assert all(np.array_equal(np.float32(back[k]), np.float32(rows[k])) for k in rows)


def test_clusters_are_skipped(spark, tmp_path):
    """Vectors in groups: a query opens few clusters, and the result is that of the scan."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((30, 24)).repeat(80, axis=0) * 3 + rng.standard_normal((2400, 24)) * 0.2).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<float>")
    V.write(df, str(tmp_path), "id", F.col("v"))
    queries, report = x[::240].astype(np.float64) + 0.05, {}
    got = {}
    for r in V.nearest(spark, str(tmp_path), queries.tolist(), 10, report=report).orderBy("rank").collect():
        got.setdefault(r.query, []).append(r.key)
    for q, point in enumerate(queries):
        assert got[q] == np.lexsort((np.arange(len(x)), np.sqrt(((x - point) ** 2).sum(axis=1))))[:10].tolist()
    assert report["clusters"] < 0.2 * report["of"] and report["compared"] < 0.2 * len(queries) * len(x)


def test_nearest_of_few_and_equal_vectors(spark, tmp_path):
    rows = [(k, [float(k % 3), 1.0]) for k in range(12)] + [(50, None)]
    V.write(spark.createDataFrame(rows, "k int, v array<float>"), str(tmp_path), "k", F.col("v"), pivots=3)
    got = [(r.key, r.distance) for r in V.nearest(spark, str(tmp_path), [[0.0, 1.0]], 5).orderBy("rank").collect()]
    assert got == [(0, 0.0), (3, 0.0), (6, 0.0), (9, 0.0), (1, 1.0)]
    assert V.nearest(spark, str(tmp_path), [[0.0, 1.0], [5.0, 5.0]], 40).count() == 24
    with pytest.raises(ValueError):
        V.nearest(spark, str(tmp_path), [[1.0]], 2)
    with pytest.raises(Exception, match="not 2 components"):
        V.write(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "k int, v array<float>"), str(tmp_path / "b"), "k", F.col("v"))
    V.write(spark.createDataFrame([], "k bigint, v array<float>"), str(tmp_path / "e"), "k", F.col("v"))
    assert V.vectors(spark, str(tmp_path / "e")).count() == 0


def test_nearest_of_many_clusters(few, tmp_path):
    """600 clusters of which every query opens all: vectors without groups."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1800, 6)).astype(np.float32)
    V.write(few.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<float>"), str(tmp_path), "id", F.col("v"), pivots=600)
    queries, report = [[9.0] * 6, [0.0] * 6], {}
    got = {}
    for r in V.nearest(few, str(tmp_path), queries, 1500, report=report).orderBy("rank").collect():
        got.setdefault(r.query, []).append(r.key)
    assert report["clusters"] > 1000
    for q, point in enumerate(queries):
        assert got[q] == np.lexsort((np.arange(len(x)), np.sqrt(((x - np.array(point)) ** 2).sum(axis=1))))[:1500].tolist()


def test_counts_follow_changes(few, tmp_path):
    """After each of five random refreshes the counts equal those taken anew: links, redirects, pages and embeddings come and go."""
    spark, rng = few, random.Random(12)
    names = [f"P{k}" for k in range(16)]

    def text():
        if rng.random() < 0.3:
            return f"#REDIRECT [[{rng.choice(names)}]]"
        return " ".join(f"[[{rng.choice(names)}]]" for _ in range(rng.randrange(0, 6)))

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    pages = {t: text() for t in names[:12]}
    embedded = {"P1", "P3"}
    folder = str(tmp_path / "s")
    C.build(spark, folder, frame(list(pages.items()), "title string, text string"), frame([(t,) for t in embedded], "title string"), buckets=2)
    for n in range(5):
        changed = {t: text() for t in rng.sample(names, 5)}
        gone = {t for t in rng.sample(names, 1) if t in pages} - set(changed)
        newly = {t for t in rng.sample(names, 2) if t not in embedded}
        no_longer = {t for t in rng.sample(names, 1) if t in embedded}
        if n == 2:
            changed, gone = {}, set()
        pages = {t: x for t, x in pages.items() if t not in gone} | changed
        embedded = (embedded - no_longer) | newly
        one = lambda ts: frame([(t,) for t in ts], "title string")
        given = frame(list(changed.items()), "title string, text string")
        Store(spark, folder).transact(lambda tx, g=given, a=one(gone), b=one(newly), c=one(no_longer): C.apply(tx, g, a, b, c))
        articles = L.with_redirects(frame(list(pages.items()), "title string, text string"))
        wanted = dict(L.unembedded_one_hop(L.edges(articles), articles.select("title", "redirect_to", "is_redirect"), one(embedded)).collect())
        assert dict(C.counts(spark, folder).collect()) == wanted, n
