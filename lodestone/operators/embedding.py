"""Embedding jobs as batches: what changed is chunked and embedded, the rest is left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as X
from lodestone.operators import index
from lodestone.operators.chunks import article_chunks, paper_chunks
from lodestone.operators.merges import delete, embedded_state
from lodestone.operators.retrieval import hashed_embedding
from lodestone.scratch import cut
from lodestone.sources.store import Store, Transaction


def changed(articles: DataFrame, meta: DataFrame) -> DataFrame:
    """Articles that are new or of another revision than was embedded, with `state`."""
    state = embedded_state(articles, meta, "page_id", "revision_id").filter("state <> 'skipped'")
    return articles.join(state, "page_id")


def embed_articles(articles: DataFrame, meta: DataFrame, dimension: int, embed=hashed_embedding) -> DataFrame:
    """Chunks of all changed articles with `embedding`; `embed(prompt column, dimension)` may be any provider."""
    todo = changed(articles, meta)
    prose = article_chunks(todo, "page_id", "title", "text").join(todo.select("page_id", "title", "revision_id"), "page_id")
    prompt = X.document_prompt(F.col("title"), F.col("section"), F.col("text"))
    return prose.withColumn("embedding", embed(prompt, dimension))


def replace_chunks(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """`old` without the chunks of re-embedded pages, and the new ones."""
    return delete(old, new.select(key).distinct(), key).unionByName(new.select(*old.columns))


def new_meta(meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """`meta` (page_id, title, revision_id) with the pages that have chunks now; a page whose embedding failed stays to be done."""
    done = chunks.groupBy("page_id").agg(F.first("title").alias("title"), F.first("revision_id").alias("revision_id"))
    return delete(meta, done, "page_id").unionByName(done.select(*meta.columns))


def embed_papers(papers: DataFrame, html: Column, dimension: int, embed=hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """(papers with status and chunk_count, their chunks with embeddings): no_html where a paper has none, embedded otherwise."""
    read = papers.select("id", F.when(F.trim(F.coalesce(html, F.lit(""))) != "", H.html_to_markdown(html)).alias("markdown"))
    chunks = paper_chunks(read.filter("markdown IS NOT NULL"), "id", "markdown").withColumn("embedding", embed(F.col("text"), dimension))
    counts = chunks.groupBy("id").agg(F.count("*").alias("chunk_count"))
    status = F.when(F.col("markdown").isNull(), "no_html").otherwise("embedded")
    done = read.join(counts, "id", "left").select("id", status.alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return done, chunks


def embed_counts(articles: DataFrame, meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row about an embedding job: articles new, updated, skipped and failed (without a chunk), and chunks."""
    state = embedded_state(articles, meta, "page_id", "revision_id")
    found = state.join(chunks.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left")
    of = lambda s: F.count_if((F.col("state") == s) & F.col("n").isNotNull())
    return found.agg(
        of("new").alias("new"), of("updated").alias("updated"), F.count_if(F.col("state") == "skipped").alias("skipped"),
        F.count_if((F.col("state") != "skipped") & F.col("n").isNull()).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
    )


def embed_abstracts(papers: DataFrame, meta: DataFrame, dimension: int, embed=hashed_embedding) -> DataFrame:
    """(id, oai_datestamp, state, embedding) of papers whose abstract is new or of another datestamp than in `meta` (id, oai_datestamp); one paper or all."""
    state = embedded_state(papers, meta, "id", "oai_datestamp").filter("state <> 'skipped'")
    todo = papers.join(state, "id")
    return todo.select("id", "oai_datestamp", "state", embed(X.paper_prompt(F.col("title"), F.col("abstract"), F.col("categories")), dimension).alias("embedding"))


def run_embedding(spark: SparkSession, articles: DataFrame, folder: str, dimension: int, embed=hashed_embedding) -> dict[str, int]:
    """One job over a corpus's articles (page_id, title, revision_id, text), all or one: what changed is chunked, embedded and indexed anew.

    `folder` is a store: `chunks` with their vectors, `articles_meta` with what is embedded,
    the index over the chunks and the dimension change in one commit, so a job that breaks
    off has changed nothing, and one that meets another starts again from what that has
    written. Pages without a chunk, such as redirects, are recorded too; a page with a chunk
    that `embed` gives null for has failed and stays to be done.
    """

    def work(tx: Transaction) -> dict[str, int]:
        known = tx.values.setdefault("embedding_dim", dimension)
        if known != dimension:
            raise ValueError(f"vectors have {dimension} components, the corpus has {known}")
        meta = tx.read("articles_meta") if tx.has("articles_meta") else spark.createDataFrame([], "page_id bigint, title string, revision_id bigint")
        state = cut(embedded_state(articles, meta, "page_id", "revision_id"))
        new = cut(_with_ids(embed_articles(articles, meta, dimension, embed)))
        failed = cut(new.filter("embedding IS NULL").select("page_id").distinct())
        todo = cut(state.filter("state <> 'skipped'").join(failed, "page_id", "left_anti"))
        good = new.join(failed, "page_id", "left_anti")
        counts = good.groupBy("page_id").agg(F.count("*").alias("n"))
        of = lambda s: F.count_if((F.col("state") == s) & F.col("n").isNotNull())
        found = todo.join(counts, "page_id", "left").agg(
            of("new").alias("new"), of("updated").alias("updated"), F.count_if(F.col("n").isNull()).alias("empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")
        ).first()
        out = {**found.asDict(), "skipped": state.filter("state = 'skipped'").count(), "failed": failed.count()}
        if out["new"] + out["updated"] + out["empty"]:
            tx.create("chunks", new.schema, ["page_id"])
            tx.create("articles_meta", meta.schema, ["page_id"])
            gone = cut(tx.read("chunks").join(todo, "page_id", "left_semi").select("chunk_id")) if tx.has("chunks") else None
            tx.delete("chunks", todo)
            tx.append("chunks", good)
            index.add(tx, good.select("chunk_id", "text"), "chunk_id", F.col("text"), gone=gone)
            tx.upsert("articles_meta", articles.join(todo, "page_id", "left_semi"))
        return out

    return Store(spark, folder).transact(work)


def _with_ids(chunks: DataFrame) -> DataFrame:
    """Chunks named by their page, their place in it and their number there."""
    return chunks.withColumn("chunk_id", F.concat_ws("-", "page_id", "place", "chunk_index"))


def forget_pages(spark: SparkSession, folder: str, pages: DataFrame) -> None:
    """Take pages (page_id) out of chunks, index and what is recorded as embedded, in one commit."""

    def work(tx: Transaction) -> None:
        index.remove(tx, tx.read("chunks").join(pages, "page_id", "left_semi").select("chunk_id"))
        tx.delete("chunks", pages)
        tx.delete("articles_meta", pages)

    Store(spark, folder).transact(work)


def run_papers(spark: SparkSession, papers: DataFrame, html: Column, folder: str, dimension: int, embed=hashed_embedding) -> dict[str, int]:
    """Full texts of papers, their chunks and the status of each paper in one commit to the store `folder`.

    A status is embedded, no_html, or failed where `embed` gives null for a chunk; of a failed
    paper no chunk is kept, and a later run takes it up again. Papers that are embedded or
    have no HTML are left alone.
    """

    def work(tx: Transaction) -> dict[str, int]:
        old = tx.read("papers") if tx.has("papers") else None
        todo = papers if old is None else papers.join(old.filter("status <> 'failed'").select("id"), "id", "left_anti")
        done, chunks = embed_papers(todo, html, dimension, embed)
        chunks = cut(chunks)
        failed = cut(chunks.filter("embedding IS NULL").select("id").distinct())
        status = done.join(failed.withColumn("_failed", F.lit(True)), "id", "left")
        bad = F.col("_failed").isNotNull()
        status = cut(status.select("id", F.when(bad, "failed").otherwise(F.col("status")).alias("status"), F.when(bad, 0).otherwise(F.col("chunk_count")).alias("chunk_count")))
        tx.create("papers", status.schema, ["id"])
        tx.create("paper_chunks", chunks.schema, ["id"])
        if not status.isEmpty():
            tx.upsert("papers", status)
            tx.append("paper_chunks", chunks.join(failed, "id", "left_anti"))
        return {r.status: r.n for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}

    return Store(spark, folder).transact(work)
