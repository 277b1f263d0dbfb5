"""Dumps, harvests, publishing, the refresh stream, queues and link counts on small inputs."""

import bz2

import pytest
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.operators import links as L
from lodestone.operators import merges as M
from lodestone.operators import queue as Q
from lodestone.operators import retrieval as R
from lodestone.sources import catalog, harvest, paging, presence, publish, settings, wiki_dump

PAGE = "<page><title>{t}</title><ns>{n}</ns><id>{i}</id><revision><id>{r}</id><timestamp>2026</timestamp><contributor><username>u</username><id>7</id></contributor><text bytes=\"3\" xml:space=\"preserve\"> {x} </text></revision></page>"


def dump(*pages, end="</mediawiki>"):
    return ('<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/">' + "\n".join(pages) + end).encode()


def test_dump(spark, tmp_path):
    pages = [PAGE.format(t="A", n=0, i=1, r=10, x="one"), PAGE.format(t="Talk:A", n=1, i=2, r=11, x="two"), PAGE.format(t="B", n=0, i="x", r=12, x="3"), PAGE.format(t="C", n=0, i=4, r="", x="4")]
    (tmp_path / "simple-1-pages-articles-multistream.xml.bz2").write_bytes(bz2.compress(dump(*pages)))
    (tmp_path / "simple-0-pages-articles.xml.bz2").write_bytes(b"")
    path = wiki_dump.latest_dump(spark, str(tmp_path), "simple")
    assert path.endswith("multistream.xml.bz2")
    rows = wiki_dump.articles(wiki_dump.read_dump(spark, path)).collect()
    assert [(r.page_id, r.title, r.revision_id, r.text_content, r.text_bytes, r.contributor_id) for r in rows] == [(1, "A", 10, " one ", 3, 7)]
    with pytest.raises(FileNotFoundError):
        wiki_dump.latest_dump(spark, str(tmp_path), "other")


def test_truncated_dump(spark, tmp_path):
    whole = PAGE.format(t="A", n=0, i=1, r=10, x="one")
    (tmp_path / "d.xml").write_bytes(dump(whole, whole[:60], end=""))
    assert wiki_dump.articles(wiki_dump.read_dump(spark, str(tmp_path / "d.xml"))).count() == 1


def test_harvest(spark, tmp_path):
    record = '<record><header{s}><datestamp>2026-01-02</datestamp></header><metadata><arXiv><id>{i}</id><title>A\n  b</title><authors><author><keyname>K</keyname><forenames>F</forenames></author><author><keyname>L</keyname></author></authors><categories>cs.CL cs.LG</categories><abstract> x  y </abstract></arXiv></metadata></record>'
    (tmp_path / "a.xml").write_text("<OAI-PMH><ListRecords>" + record.format(s="", i="1") + record.format(s=' status="deleted"', i="2") + "<record><header><datestamp>d</datestamp></header></record></ListRecords></OAI-PMH>")
    (row,) = harvest.papers(harvest.read_cache(spark, str(tmp_path / "a.xml"))).collect()
    assert (row.id, row.title, row.abstract, row.authors, row.primary_category, row.doi) == ("1", "A b", "x y", ["F K", "L"], "cs.CL", None)


def test_publish(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.range(3), path)
    publish.publish(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception):
        publish.publish(spark.range(2).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert spark.read.parquet(path).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    assert publish.read_with_defaults(spark, path, {"id": "0", "flag": "1"}).columns == ["id", "flag"]


def test_refresh_keeps_columns(spark):
    old = spark.createDataFrame([(1, 1, "a", 10, "x"), (2, 1, "b", 20, "y")], "page_id int, revision_id int, body string, created int, own string")
    feed = spark.createDataFrame([(1, 2, "A", 99), (3, 1, "C", 98), (2, 1, "skip", 97)], "page_id int, revision_id int, body string, created int")
    merged, archive = M.refresh(old, feed, kept=["created"])
    assert sorted(map(tuple, merged.collect())) == [(1, 2, "A", 10, "x"), (2, 1, "b", 20, "y"), (3, 1, "C", 98, None)]
    assert [tuple(r) for r in archive.collect()] == [(1, 1, "a", 10, "x")]


def test_truncated_archive(spark, tmp_path):
    """A compressed dump that breaks off: pages of whole blocks before the break are kept, the read does not fail."""
    pages = "".join(PAGE.format(t=f"P{k}", n=0, i=k, r=k + 1, x="".join(chr(97 + (k * j * 7919) % 26) for j in range(3000))) for k in range(900))
    whole = bz2.compress(dump(pages), 1)
    (tmp_path / "d.xml.bz2").write_bytes(whole[: len(whole) * 2 // 3])
    rows = wiki_dump.articles(wiki_dump.read_dump(spark, str(tmp_path / "d.xml.bz2")))
    assert rows.count() < 900 and rows.filter("title IS NULL").count() == 0


def test_replayed_pages_are_in_order(spark, tmp_path):
    record = "<record><header><datestamp>2026-01-0{d}</datestamp></header><metadata><arXiv><id>{i}</id><title>t</title><categories>c</categories></arXiv></metadata></record>"
    for name, ids in (("b", (3, 4)), ("a", (1, 2))):
        (tmp_path / f"{name}.xml").write_text("<OAI-PMH>" + "".join(record.format(d=i, i=i) for i in ids) + "</OAI-PMH>")
    rows = harvest.read_cache(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.metadata.arXiv.id for r in rows] == ["1", "2", "3", "4"]


def test_small_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    publish.publish(spark.range(3), path, mark="one")
    assert publish.published(spark, path, "one") and not publish.published(spark, path, "two")
    publish.reset(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]
    for n in (1, 2):
        publish.log_run(spark, str(tmp_path / "log"), {"run": n, "rows": 10 * n}, "run int, rows int")
    assert sorted(r.rows for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [10, 20]
    publish.write_side_files(spark.createDataFrame([("a/1", "# x\ny"), ("b", None)], "id string, md string"), str(tmp_path / "side"), "id", "md")
    publish.write_side_files(spark.createDataFrame([("a_1", "other"), ("c", "1")], "id string, md string"), str(tmp_path / "side"), "id", "md")
    publish.write_side_files(spark.createDataFrame([("c", "2")], "id string, md string"), str(tmp_path / "side"), "id", "md")
    assert sorted(map(tuple, publish.read_side_files(spark, str(tmp_path / "side")).collect())) == [("a/1", "# x\ny\n"), ("a_1", "other\n"), ("c", "2\n")]


def test_catalog(spark, tmp_path):
    for corpus, name in (("simple", "articles"), ("simple", "chunks"), ("other", "articles")):
        publish.publish(spark.range(2), str(tmp_path / corpus / name))
    assert catalog.corpora(spark, str(tmp_path), "articles") == ["other", "simple"]
    assert catalog.corpora(spark, str(tmp_path), "chunks") == ["simple"]
    assert catalog.open_table(spark, str(tmp_path), "simple", "chunks").count() == 2
    with pytest.raises(FileNotFoundError):
        catalog.open_table(spark, str(tmp_path), "other", "chunks")
    scan = spark.createDataFrame([(3, 0, "c"), (1, 0, "a"), (2, 1, "b")], "page_id int, namespace int, t string")
    assert [r.page_id for r in catalog.ordered_scan(scan.filter("namespace = 0"), "page_id", 5).collect()] == [1, 3]
    publish.publish(spark.createDataFrame([("A",)], "title string"), str(tmp_path / "simple" / "titles"))
    publish.publish(spark.createDataFrame([("B",)], "title string"), str(tmp_path / "other" / "titles"))
    assert catalog.corpora_with(spark, str(tmp_path), "titles", "title", "B") == ["other"]
    assert R.checked_request(" q ", "simple", 5, ["simple"]) == ("q", "simple", 5)
    for bad in ((" ", "simple", 5), ("q", "", 5), ("q", "simple", 0), ("q", "simple", 51)):
        with pytest.raises(ValueError):
            R.checked_request(*bad, ["simple"])
    with pytest.raises(LookupError):
        R.checked_request("q", "none", 5, ["simple"])
    info = catalog.corpus_info(spark, str(tmp_path), "simple", {"display_name": "Simple", "model": "m", "dimension": "8", "max_top_k": "50"}, "chunks")
    assert (info["corpus"], info["embedded"], info["display_name"]) == ("simple", 2, "Simple")


def test_pages_of_any_place(spark, tmp_path):
    """The first, a middle and the last page, and one behind it, from two files at most."""
    names = [f"{k % 40:02d}" for k in range(1_000)]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string").repartition(5)
    paging.write_pages(df, str(tmp_path), ["name", "k"], rows_per_file=120)
    every = sorted((n, k) for k, n in enumerate(names))
    for number in (1, 7, 20, 21, 0):
        got = paging.page(spark, str(tmp_path), ["name", "k"], number, 50)
        first = (max(1, number) - 1) * 50
        assert [(r.name, r.k) for r in got.collect()] == every[first : first + 50]
        assert len(paging.files_of(spark, str(tmp_path), first, 50)) <= 2
        assert number == 21 or "PartitionFilters: [isnotnull(_range" in got._jdf.queryExecution().toString() or "PartitionFilters: [_range" in got._jdf.queryExecution().toString()
    paging.write_pages(df.limit(0), str(tmp_path / "e"), ["name", "k"])
    assert paging.page(spark, str(tmp_path / "e"), ["name", "k"], 1, 50).count() == 0


def test_presence(spark, tmp_path):
    """No value is missed, few others pass, added values are there, and only corpora that may have a value are opened."""
    base = str(tmp_path)
    for corpus, step in (("a", 2), ("b", 3), ("c", 5)):
        titles = spark.range(0, 100_000, step).selectExpr("concat('t', id) AS title")
        if corpus != "c":
            presence.write_presence(titles, base, corpus, "titles", "title")
        publish.publish(titles, f"{base}/{corpus}/titles")
    asked = spark.range(0, 110_000).selectExpr("concat('t', id) AS value", "id")
    found = presence.may_have(spark, base, "titles", "title", asked).join(asked, "value").groupBy("corpus").agg(F.count("*").alias("n"), F.count_if(F.col("id") < 100_000).alias("low"), F.count_if((F.col("corpus") == "a") & (F.col("id") % 2 == 0) & (F.col("id") < 100_000)).alias("a"), F.count_if((F.col("corpus") == "b") & (F.col("id") % 3 == 0) & (F.col("id") < 100_000)).alias("b"))
    got = {r.corpus: r for r in found.collect()}
    assert got["a"].a == 50_000 and got["b"].b == 33_334
    assert got["a"].n < 50_000 + 1_000 and got["b"].n < 33_334 + 1_500
    assert catalog.corpora_with(spark, base, "titles", "title", "t6") == ["a", "b"]
    assert catalog.corpora_with(spark, base, "titles", "title", "t25") == ["c"]
    presence.add_presence(spark.createDataFrame([("new",), (None,)], "title string"), base, "a", "titles", "title")
    some = spark.createDataFrame([("new",), ("t2",)], "value string")
    assert sorted(map(tuple, presence.may_have(spark, base, "titles", "title", some).filter("corpus = 'a'").collect())) == [("new", "a"), ("t2", "a")]


def test_scratch_tables(spark):
    with scratch.scope(spark):
        inner = scratch.cut(spark.range(3))
        assert inner.count() == 3
    outer = scratch.cut(spark.range(2))
    assert outer.count() == 2
    with pytest.raises(Exception):
        inner.count()
    scratch.forget(outer)
    with pytest.raises(Exception):
        outer.count()


def test_settings(spark, tmp_path):
    path = str(tmp_path / "meta")
    assert settings.get(spark, path, "a") is None
    settings.put(spark, path, {"a": "1", "b": "2"})
    settings.put(spark, path, {"a": "3"})
    assert (settings.get(spark, path, "a"), settings.get(spark, path, "b")) == ("3", "2")
    settings.fix_dimension(spark, path, 768)
    settings.fix_dimension(spark, path, 768)
    with pytest.raises(ValueError, match="768"):
        settings.fix_dimension(spark, path, 64)


def test_retrieve(spark, tmp_path):
    from lodestone.operators import index as I

    path = str(tmp_path / "i")
    I.write(spark.createDataFrame([(1, "cats purr"), (2, "dogs bark"), (3, "cats and dogs")], "id bigint, t string"), path, "id", F.col("t"))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1])], "id bigint, v array<float>")
    meta = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "id bigint, title string")
    search = lambda q: I.search(spark, path, q).withColumnRenamed("key", "id")

    def fail(_):
        raise OSError

    ask = lambda q, embed: R.retrieve(q, search, "id", vectors, F.col("v"), embed, meta)
    hits, dense = ask(" cats ", lambda _: [1.0, 0.0])
    assert dense and [r.title for r in hits.collect()][:2] == ["One", "Three"]
    hits, dense = ask("cats", fail)
    assert not dense and {r.title for r in hits.collect()} == {"One", "Three"}
    assert ask("  ", lambda _: [1.0, 0.0])[0].count() == 0
    hits, dense = ask("?", lambda _: [0.0, 1.0])
    assert dense and hits.first().title == "Two"


def test_links_and_counts(spark):
    pages = [("A", "[[B]] [[C]] [[A]]"), ("B", "[[D]] [[E]] [[A]]"), ("C", "[[E]] [[F]] [[Bredirect]]"), ("D", ""), ("E", ""), ("F", ""), ("Bredirect", "#REDIRECT [[B]]"), ("X", "#REDIRECT [[Y]]"), ("Y", "#REDIRECT [[X]]"), ("G", "[[Bredirect]] [[X]] [[none]]")]
    articles = L.with_redirects(spark.createDataFrame(pages, "title string, text string"))
    edges = L.edges(articles)
    narrow = articles.select("title", "redirect_to", "is_redirect")
    nested = spark.createDataFrame([("A", "{{t|[[in]]}} [[File:x|see [[b]]]] <!-- [[no]] --> [[c|[[d]]]] [[open"), ("R", "#REDIRECT [[x]]")], "title string, text string")
    assert [(r.dst, r.pos) for r in L.accurate_edges(nested).orderBy("pos").collect()] == [("In", 0), ("B", 1), ("C", 2), ("D", 3)]
    embedded = spark.createDataFrame([("E",)], "title string")
    resolved = {r.title: r.resolved for r in L.resolve_redirects(narrow.select("title"), narrow).collect()}
    assert resolved["Bredirect"] == "B" and resolved["X"] is None and resolved["A"] == "A"
    one = dict(L.unembedded_one_hop(edges, narrow, embedded).collect())
    assert one == {"A": 2, "B": 2, "C": 2, "G": 1}
    two = dict(L.unembedded_two_hop(edges, narrow, embedded, spark.createDataFrame([("A",), ("G",)], "title string")).collect())
    assert two == {"A": 4, "G": 3}


def test_queue(spark):
    items = spark.createDataFrame([(1, "A", "queued", 0, 0), (1, "B", "complete", 0, 0)], "job_id int, title string, status string, hops_remaining int, force int")
    new = spark.createDataFrame([(1, "A", 2, 0), (1, "A", 1, 1), (1, "B", 3, 1), (2, "A", 0, 0)], "job_id int, title string, hops_remaining int, force int")
    got = {(r.job_id, r.title): (r.status, r.hops_remaining, r.force) for r in Q.enqueue(items, new).collect()}
    assert got == {(1, "A"): ("queued", 2, 1), (1, "B"): ("complete", 0, 0), (2, "A"): ("queued", 0, 0)}
    articles = spark.createDataFrame([("A", 1, False), ("B", 1, False), ("C", 1, False)], "title string, revision_id int, is_redirect boolean")
    meta = spark.createDataFrame([("C", 1)], "title string, revision_id int")
    edges = spark.createDataFrame([("A", "B", 0), ("B", "C", 0), ("C", "Z", 0)], "src string, dst string, pos int")
    start = spark.createDataFrame([(1, "A", "queued", 2, 0)], items.schema)
    got = {r.title: r.status for r in Q.drain(start, articles, meta, edges, 2).collect()}
    assert got == {"A": "complete", "B": "complete", "C": "skipped_unchanged"}
    asked = iter([False, True])
    got = {r.title: r.status for r in Q.drain(start, articles, meta, edges, 2, lambda: next(asked, True)).collect()}
    assert got == {"A": "complete", "B": "queued"}


def test_queue_life(spark):
    jobs = spark.createDataFrame([(1, "w", "running", 0, None), (2, "w", "queued", 0, None), (3, "v", "queued", 1, None), (4, "v", "queued", 0, None)], "job_id int, corpus string, status string, cancel_requested int, started_at string")
    got = {r.job_id: (r.status, r.started_at) for r in Q.promote(jobs, F.lit("now")).collect()}
    assert got == {1: ("running", None), 2: ("queued", None), 3: ("queued", None), 4: ("running", "now")}
    items = spark.createDataFrame([(1, 1, "queued"), (2, 2, "queued"), (3, 1, "complete")], "item_id int, job_id int, status string")
    after, left = Q.cancel(jobs, items, [1, 2])
    assert {r.job_id: (r.status, r.cancel_requested) for r in after.collect()} == {1: ("running", 1), 2: ("cancelled", 1), 3: ("queued", 1), 4: ("queued", 0)}
    assert [r.item_id for r in left.collect()] == [3]
    papers = spark.createDataFrame([("a",), ("b",)], "id string")
    queued = spark.createDataFrame([(1, "a", "queued", 5, None, None), (2, "b", "queued", None, None, None), (3, "z", "queued", None, None, None), (4, "a", "failed", None, "old", "then")], "item_id int, arxiv_id string, status string, chunk_count int, error_message string, finished_at string")
    results = spark.createDataFrame([("a", "embedded", None), ("b", "no_html", 0)], "id string, status string, chunk_count int")
    got = {r.item_id: (r.status, r.chunk_count, r.error_message, r.finished_at) for r in Q.settle_papers(queued, papers, results, F.lit("now")).collect()}
    assert got == {1: ("embedded", 5, None, "now"), 2: ("no_html", 0, None, "now"), 3: ("failed", None, "unknown paper", "now"), 4: ("failed", None, "old", "then")}


def test_finalise(spark):
    meta = spark.createDataFrame([("A", 0, 0, 7, 7), ("B", 0, 0, 7, 7), ("C", 1, 0, 7, 7)], "title string, links_embedded int, links_embedded_2hop int, n_links long, n_links_2hop long")
    items = spark.createDataFrame([("A", "complete", 0), ("A", "queued", 1), ("B", "failed", 1), ("C", "in_progress", 0)], "source_title string, status string, hops_remaining int")
    counts = spark.createDataFrame([("A", 3), ("C", 4)], "src string, n_links long")
    second = spark.createDataFrame([("A", 30)], "src string, n_links long")
    got = {r.title: tuple(r)[1:] for r in Q.finalise(meta, items, counts, second).collect()}
    assert got == {"A": (1, 0, 3, 7), "B": (1, 1, 0, 0), "C": (1, 0, 7, 7)}


def test_link_items(spark):
    pages = [("A", "[[B]] [[R]] [[gone]] [[A]]"), ("B", ""), ("R", "#REDIRECT [[B]]")]
    articles = L.with_redirects(spark.createDataFrame(pages, "title string, text string"))
    items = Q.link_items(spark.createDataFrame([(1, "A")], "job_id int, title string"), L.edges(articles), articles, 1)
    assert sorted((r.title, r.hops_remaining) for r in items.collect()) == [("A", 0), ("B", 1), ("Gone", 1)]


def test_guards(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "k int, v array<float>")
    with pytest.raises(Exception, match="not 2 components"):
        R.one_dimension(df, "v", 2).collect()
    with pytest.raises(ValueError):
        R.hybrid(df.select("k", F.lit(1.0).alias("score")), "k", None, None, None, top_k=51)


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("a b",), ("b a",), ("",)], "t string")
    a, b, c = (r[0] for r in df.select(R.hashed_embedding(F.col("t"), 8)).collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and set(c) == {0.0}


def test_empty_tables(spark):
    old = spark.createDataFrame([], "page_id bigint, revision_id bigint, body string")
    merged, archive = M.refresh(old, old)
    assert merged.count() == 0 and archive.count() == 0 and M.counters(M.refresh_actions(old, old)).first().scanned == 0
