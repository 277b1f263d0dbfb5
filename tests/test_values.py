"""Rows of the queries that SQL cannot express, worked out independently of the operators."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import tokens as T
from lodestone.functions import wikitext as W
from lodestone.plans import catalog
from lodestone.plans.corpus import articles, embedded
from tests.test_text import pack

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text.translate(UP))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return articles(spark, sf_dir).collect()


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: catalog.QUERIES[name](spark, sf_dir).collect()


def test_stemmed_frequency(run, docs):
    counts, forms = Counter(), {}
    for d in docs:
        for w in words(d.text or ""):
            counts[T.stem(w)] += 1
            forms.setdefault(T.stem(w), set()).add(w)
    assert {r.stem: (r.cf, r.n_words) for r in run("stemmed_frequency")} == {s: (n, len(forms[s])) for s, n in counts.items()}


def test_hashed_embeddings(spark, sf_dir, run):
    texts = {r.page_id: re.sub("<[^>]*>", " ", r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    known = sorted({w for t in texts.values() for w in words(t)})
    hashed = spark.createDataFrame([(w,) for w in known], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(16)).alias("p"), (F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) * 2 - 1).alias("s"))
    place = {r.w: (r.p, r.s) for r in hashed.collect()}
    for r in run("hashed_embeddings"):
        v = [0.0] * 16
        for w in words(texts[r.page_id]):
            v[place[w][0]] += place[w][1]
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert all(abs(a - b / norm) < 2e-5 for a, b in zip(r.embedding, v, strict=True))


def test_packed_chunks(run, docs):
    wanted = {(d.doc_id, k): p for d in docs if d.text is not None for k, p in enumerate(pack(d.text.replace("\n", "\n\n"), 600))}
    assert {(r.doc_id, r.chunk_index): r.text for r in run("packed_chunks")} == wanted


def test_paper_chunks(run, docs):
    wanted = {}
    for d in docs:
        body = re.sub(r"\n[ \t]*\n\s*", "\n\n", re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", d.text or ""))
        if d.text is not None:
            for section, text in (("", "Lead"), ("A", body), ("B", d.source)):
                wanted |= {(d.doc_id, section, k): p for k, p in enumerate(pack(text, 1600)) if text}
    assert {(r.doc_id, r.section, r.chunk_index): r.text for r in run("paper_chunks")} == wanted


def test_article_chunks_and_embeddings(spark, sf_dir, run, pages):
    wanted = {}
    for p in pages:
        if p.page_id % 7 == 3:
            continue
        k = p.page_id
        wanted[k, None, 0] = f"t{k // 2} label  t{k + 1}  t{k // 2}  k"
        body = p.text.split(" ==\n", 1)[1]
        # markup in the documents' own text is left to the tests of W.plain
        plain = re.sub(r"\n{3,}", "\n\n", body.strip() if not re.search(r"''|[\[<{]|\|", body) else W.plain(W.cut_tables(W.inline_formulas(body))[1]))
        wanted |= {(k, f"S{k % 4}", i): x for i, x in enumerate(pack(plain, 1600)) if plain}
    assert {(r.page_id, r.section, r.chunk_index): r.text for r in run("article_chunks")} == wanted
    done = {r.page_id: r.revision_id for r in embedded(spark, sf_dir).collect()}
    todo = {(k, s, i): len(x) for (k, s, i), x in wanted.items() if done.get(k) != k * 10 + k % 3}
    got = run("embed_articles")
    assert {(r.page_id, r.section, r.chunk_index): r.text_length for r in got} == todo and {r.dimension for r in got} == {8}


def test_plain_text(spark, sf_dir, pages):
    """The column functions against the bracket reader."""
    from lodestone.functions import text as X

    got = articles(spark, sf_dir).select("page_id", X.strip_markup(F.col("text")).alias("plain")).collect()
    texts = {p.page_id: p.text for p in pages}
    assert all(r.plain == W.plain(texts[r.page_id]) for r in got)


def test_markup_html(spark, sf_dir, pages):
    from lodestone.functions import text as X

    got = {r.page_id: r.html for r in articles(spark, sf_dir).select("page_id", X.markup_to_html(F.col("text")).alias("html")).collect()}
    link = lambda m: f'<a href="/article/{m[1]}">{m[2] or m[1]}{m[3]}</a>'
    for p in pages:
        text = p.text.replace("[[File:x.png|thumb]]", "")
        text = re.sub(r"\[\[Category:[^\]]*\]\]", "", text)
        text = re.sub(r"(?m)^== (S\d) ==$", r'<h2 id="\1">\1</h2>', text)
        text = re.sub(r"\[\[([^\[\]|]+)(?:\|([^\[\]]+))?\]\]([a-z]*)", link, text)
        text = re.sub(r"(?m)[ \t\r\f\v]+$", "", re.sub(r"\n{3,}", "\n\n", text))
        if not re.search(r"''|__[A-Z]|\{\{|<ref|^=", p.text.split("==\n", 1)[-1]):
            assert got[p.page_id] == text


def test_html_markdown(spark, sf_dir, run):
    """Every word of a page's body but those of left-out elements, in order; no other words."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in run("html_markdown"):
        html = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|header|footer|h1|head)\b.*?</\1>", " ", pages[r.page_id])
        text = re.sub(r"&(?:amp|lt|gt|quot|nbsp|#\d+|#x[0-9a-f]+);", " ", re.sub(r"<[^>]*>", " ", html))
        links = re.sub(r"\]\([^)]*\)", " ", r.markdown)
        assert re.findall(r"[^\W_]+", re.sub(r"(?m)^\d+\. ", " ", links)) == re.findall(r"[^\W_]+", text)


def test_queue_drain(run, pages, spark, sf_dir):
    """The frontier of each job by hand: settle, follow links, settle."""
    done = {r.title: r.revision_id for r in embedded(spark, sf_dir).collect()}
    real = {p.title: p for p in pages}
    links = {e.src: [] for e in catalog.QUERIES["link_edges"](spark, sf_dir).collect()}
    for e in catalog.QUERIES["link_edges"](spark, sf_dir).collect():
        links[e.src].append(e.dst)

    def status(title):
        p = real.get(title)
        return "not_found" if p is None else "skipped_redirect" if p.page_id % 7 == 3 else "skipped_unchanged" if done.get(title) == p.revision_id else "complete"

    jobs = {}
    for p in pages:
        jobs.setdefault(p.page_id % 3, {})[p.title] = 2
    for items in jobs.values():
        frontier = dict(items)
        for _ in range(2):
            new = {}
            for title, hops in frontier.items():
                if hops > 0 and status(title) in ("complete", "skipped_unchanged"):
                    for target in links.get(title, ()):
                        if target not in items:
                            new[target] = max(new.get(target, 0), hops - 1)
            items |= new
            frontier = new
    got = {(r.job_id, r.title): r.status for r in run("queue_drain")}
    assert got == {(j, t): status(t) for j, items in jobs.items() for t in items}
