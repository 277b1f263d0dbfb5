"""Job queues as tables: enqueue, promotion, states, cancelling, recovery, and a frontier that expands links hop by hop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.links import resolve_redirects
from lodestone.scratch import cut
from lodestone.sources.store import Store, Transaction

OPEN = ["queued", "in_progress"]
TERMINAL = ["complete", "failed", "not_found", "skipped_redirect", "skipped_unchanged", "embedded", "no_html", "skipped"]


def enqueue(items: DataFrame, new: DataFrame) -> DataFrame:
    """`items` (job_id, title, status, hops_remaining, force) with `new` (job_id, title, hops_remaining, force) merged in.

    Of equal (job_id, title) one stays with the most hops and force; an item that is no
    longer queued keeps its own.
    """
    asked = new.groupBy("job_id", "title").agg(F.max("hops_remaining").alias("_hops"), F.max("force").alias("_force"))
    both = items.join(asked, ["job_id", "title"], "full_outer")
    fresh = F.col("status").isNull()
    grows = fresh | (F.col("status") == "queued")
    most = lambda own, asked: F.when(grows, F.greatest(F.col(own), F.col(asked))).otherwise(F.col(own))
    return both.select(
        "job_id", "title", F.coalesce("status", F.lit("queued")).alias("status"),
        most("hops_remaining", "_hops").alias("hops_remaining"), most("force", "_force").alias("force"),
    )


def settle(items: DataFrame, articles: DataFrame, meta: DataFrame) -> DataFrame:
    """Queued items with the status their article gives them: not_found, skipped_redirect, skipped_unchanged or complete."""
    known = articles.select("title", "revision_id", "is_redirect", F.lit(True).alias("_known"))
    done = meta.select("title", F.col("revision_id").alias("_done"))
    status = (
        F.when(F.col("status") != "queued", F.col("status"))
        .when(F.col("_known").isNull(), "not_found")
        .when(F.col("is_redirect"), "skipped_redirect")
        .when((F.col("force") == 0) & (F.col("_done") == F.col("revision_id")), "skipped_unchanged")
        .otherwise("complete")
    )
    joined = items.join(known, "title", "left").join(done, "title", "left")
    return joined.withColumn("status", status).select(*items.columns)


def expand(items: DataFrame, edge_table: DataFrame) -> DataFrame:
    """New items one hop on from items with hops left: (job_id, title, hops_remaining, force)."""
    from_ = items.filter("hops_remaining > 0 AND status IN ('complete', 'skipped_unchanged')")
    joined = from_.join(edge_table.select(F.col("src").alias("title"), "dst"), "title")
    return joined.groupBy("job_id", F.col("dst").alias("title")).agg(
        (F.max("hops_remaining") - 1).alias("hops_remaining"), F.max("force").alias("force")
    )


def drain(items: DataFrame, articles: DataFrame, meta: DataFrame, edge_table: DataFrame, hops: int, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """All items of all jobs after `hops` rounds of settling and expanding, each a job over the whole frontier.

    `cancelled` is asked before each round; once it is true, what is queued stays queued.
    """
    for _ in range(hops):
        if cancelled():
            return items
        items = settle(items, articles, meta)
        items = enqueue(items, expand(items, edge_table))
    return items if cancelled() else settle(items, articles, meta)


def link_items(sources: DataFrame, edge_table: DataFrame, articles: DataFrame, depth: int) -> DataFrame:
    """(job_id, title, source_title, hops_remaining, force) for `sources` (job_id, title): each itself without hops, and its link targets with `depth`.

    Targets are named by the end of their redirects; those without one keep their name, so
    that the queue can tell that they were not found.
    """
    first = edge_table.join(sources.select("job_id", F.col("title").alias("src")), "src")
    named = resolve_redirects(first.select(F.col("dst").alias("title")).distinct(), articles)
    targets = first.join(named, first["dst"] == named["title"]).select("job_id", F.coalesce("resolved", "dst").alias("title"), F.col("src").alias("source_title"))
    own = sources.select("job_id", "title", F.col("title").alias("source_title"))
    both = targets.filter("title <> source_title").distinct().withColumn("hops_remaining", F.lit(depth))
    return both.unionByName(own.withColumn("hops_remaining", F.lit(0))).withColumn("force", F.lit(0))


def finish(items: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """`items` (item_id, ..., status, chunk_count, error_message, finished_at) with `results` (item_id, status, chunk_count, error_message).

    A terminal status sets `finished_at`; a chunk count is kept where the result has none.
    """
    new = results.select("item_id", *(F.col(c).alias(f"_{c}") for c in ("status", "chunk_count", "error_message")), F.lit(True).alias("_given"))
    joined = items.join(new, "item_id", "left")
    given = F.col("_given").isNotNull()
    changed = {
        "status": F.col("_status"),
        "chunk_count": F.coalesce("_chunk_count", "chunk_count"),
        "error_message": F.col("_error_message"),
        "finished_at": F.when(~F.col("_status").isin(OPEN), now).otherwise(F.col("finished_at")),
    }
    return joined.select(*(F.when(given, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in items.columns))


def promote(jobs: DataFrame, now: Column) -> DataFrame:
    """`jobs` (job_id, corpus, status, cancel_requested, started_at): the oldest queued job of each corpus without a running one starts."""
    state = jobs.groupBy("corpus").agg(
        F.count_if(F.col("status") == "running").alias("_running"),
        F.min(F.when((F.col("status") == "queued") & (F.col("cancel_requested") == 0), F.col("job_id"))).alias("_next"),
    )
    starts = (F.col("_running") == 0) & (F.col("job_id") == F.col("_next"))
    joined = jobs.join(state, "corpus").withColumn("_starts", F.coalesce(starts, F.lit(False)))
    return joined.withColumns({"status": F.when(F.col("_starts"), "running").otherwise(F.col("status")), "started_at": F.when(F.col("_starts"), now).otherwise(F.col("started_at"))}).select(*jobs.columns)


def start_next(store: Store, now: Column, table: str = "jobs") -> DataFrame:
    """`promote` on a stored table: what has started, by this call and no other.

    Two calls that meet commit against the same version; one loses, looks again and finds
    the job running, so a corpus never runs two jobs.
    """

    def work(tx: Transaction) -> DataFrame:
        jobs = tx.read(table)
        started = cut(promote(jobs, now).join(jobs.filter("status = 'queued'").select("job_id"), "job_id", "left_semi").filter("status = 'running'").select(*jobs.columns))
        if not started.isEmpty():
            tx.upsert(table, started)
        return started

    return store.transact(work)


def cancel(jobs: DataFrame, items: DataFrame, job_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) after a request to stop: queued jobs are cancelled at once, running ones carry the flag; items that wait are left out."""
    asked = F.col("job_id").isin(job_ids)
    flagged = jobs.withColumns({
        "cancel_requested": F.when(asked, 1).otherwise(F.col("cancel_requested")),
        "status": F.when(asked & (F.col("status") == "queued"), "cancelled").otherwise(F.col("status")),
    })
    return flagged, items.filter(~(asked & (F.col("status") == "queued")))


def finalise(meta: DataFrame, items: DataFrame, counts: DataFrame, two_hop_counts: DataFrame) -> DataFrame:
    """`meta` (title, links_embedded, links_embedded_2hop, n_links, n_links_2hop) after its items are done.

    Source titles with an item that is done have their links embedded; those with such an
    item that had hops left, their second hop too. Their counts (src, n_links) are taken
    anew; a source without a row there has none left.
    """
    done = items.filter(~F.col("status").isin(OPEN)).groupBy(F.col("source_title").alias("title")).agg((F.max("hops_remaining") >= 1).alias("_two"))
    one = counts.select(F.col("src").alias("title"), F.col("n_links").alias("_one"))
    two = two_hop_counts.select(F.col("src").alias("title"), F.col("n_links").alias("_second"))
    joined = meta.join(done, "title", "left").join(one, "title", "left").join(two, "title", "left")
    source, second = F.col("_two").isNotNull(), F.coalesce("_two", F.lit(False))
    return joined.select(
        *(c for c in meta.columns if c not in ("links_embedded", "links_embedded_2hop", "n_links", "n_links_2hop")),
        F.when(source, 1).otherwise(F.col("links_embedded")).alias("links_embedded"),
        F.when(second, 1).otherwise(F.col("links_embedded_2hop")).alias("links_embedded_2hop"),
        F.when(source, F.coalesce("_one", F.lit(0))).otherwise(F.col("n_links")).alias("n_links"),
        F.when(second, F.coalesce("_second", F.lit(0))).otherwise(F.col("n_links_2hop")).alias("n_links_2hop"),
    )


def settle_papers(items: DataFrame, papers: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Queued papers (item_id, arxiv_id, ...) as a batch: unknown ones fail, others take the status and chunks of `results` (id, status, chunk_count)."""
    queued = items.filter("status = 'queued'").select("item_id", F.col("arxiv_id").alias("id"))
    known = papers.select("id", F.lit(True).alias("_known"))
    found = queued.join(known, "id", "left").join(results, "id", "left")
    failed = F.col("_known").isNull() | F.col("status").isNull()
    message = F.when(F.col("_known").isNull(), "unknown paper").when(failed, "no result")
    outcome = found.select("item_id", F.when(failed, "failed").otherwise(F.col("status")).alias("status"), "chunk_count", message.alias("error_message"))
    return finish(items, outcome, now)


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash, jobs or items: those that were running have failed, queued ones stay queued."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "in_progress"), "failed").otherwise(F.col("status")))
