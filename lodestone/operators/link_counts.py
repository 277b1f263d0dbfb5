"""Counts of unembedded link targets, kept up to date by what changes.

`count(src)` is the number of targets that some link of `src` leads to, through redirects,
and that are open: they exist, are no redirects and are not embedded. Beside the counts a
store keeps the links, where each link target's redirects end, and how many links of a
source lead to each target. A change of pages or of what is embedded gives signed deltas:
links that appear or go, links whose redirects end elsewhere now, and targets that open or
close. Only pairs of a source and a target that one of them touches are looked at, so a
hub's other links are never counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.links import edges, resolve_redirects, with_redirects
from lodestone.scratch import cut
from lodestone.sources.store import BUCKETS, Store, Transaction

HOPS = 5
PAGES = "title string, redirect_to string, is_redirect boolean"


def _pairs(links: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, target, n) of links (src, dst, n) by where their redirects end; a link to its own source counts nowhere."""
    named = links.join(resolved.withColumnRenamed("title", "dst"), "dst", "left")
    targets = named.select("src", F.coalesce("resolved", "dst").alias("target"), "n").filter("target <> src")
    return targets.groupBy("src", "target").agg(F.sum("n").alias("n")).filter("n <> 0")


def _open(pages: DataFrame, embedded: DataFrame) -> DataFrame:
    """(target) that exist, are no redirects and are not embedded."""
    real = pages.filter(~F.col("is_redirect")).select(F.col("title").alias("target"))
    return real.join(embedded.select(F.col("title").alias("target")), "target", "left_anti")


def build(spark: SparkSession, folder: str, articles: DataFrame, embedded: DataFrame, buckets: int = BUCKETS) -> None:
    """The state for all `articles` (title, text) and what is `embedded` (title), taken anew."""
    pages = cut(with_redirects(articles).select("title", "redirect_to", "is_redirect"))
    links = cut(edges(articles).select("src", "dst").distinct())
    resolved = cut(resolve_redirects(links.select(F.col("dst").alias("title")).distinct(), pages, HOPS))
    pairs = cut(_pairs(links.withColumn("n", F.lit(1)), resolved))
    counts = pairs.join(_open(pages, embedded), "target", "left_semi").groupBy("src").agg(F.count("*").alias("n_links"))

    def work(tx: Transaction) -> None:
        for name, df, key in (("pages", pages, "title"), ("links", links, "src"), ("resolved", resolved, "title"), ("pairs", pairs, "src"), ("embedded", embedded.select("title").distinct(), "title"), ("counts", counts, "src")):
            tx.create(name, df.schema, [key], buckets)
            tx.replace(name, df)

    Store(spark, folder).transact(work)


def _through(changed: DataFrame, pages: DataFrame) -> DataFrame:
    """Titles whose redirects run through one of `changed`: back along the redirects, hop by hop."""
    found = at = changed
    back = pages.filter("redirect_to IS NOT NULL").select("title", F.col("redirect_to").alias("_to"))
    for _ in range(HOPS):
        at = back.join(at.select(F.col("title").alias("_to")), "_to", "left_semi").select("title")
        found = found.unionByName(at)
    return found.distinct()


def apply(tx: Transaction, articles: DataFrame | None = None, gone: DataFrame | None = None, newly: DataFrame | None = None, no_longer: DataFrame | None = None) -> DataFrame:
    """Take in new or changed `articles` (title, text), pages that are `gone` and titles that are `newly` or `no_longer` embedded; gives (src, delta).

    A commit of `tx` makes it visible. Titles may stand once in each of the frames.
    """
    spark = tx.store.spark
    no = spark.createDataFrame([], "title string")
    gone, newly, no_longer = (no if df is None else df.select("title") for df in (gone, newly, no_longer))
    articles = spark.createDataFrame([], "title string, text string") if articles is None else articles
    pages, links, resolved, pairs, embedded, counts = (tx.read(n) for n in ("pages", "links", "resolved", "pairs", "embedded", "counts"))

    changed_pages = cut(with_redirects(articles).select("title", "redirect_to", "is_redirect"))
    touched = cut(changed_pages.select("title").unionByName(gone))
    new_pages = pages.join(touched, "title", "left_anti").unionByName(changed_pages)
    # links of the pages that have changed: those that go and those that come
    of_touched = touched.select(F.col("title").alias("src"))
    old_links = cut(links.join(of_touched, "src", "left_semi"))
    fresh_links = cut(edges(articles).select("src", "dst").distinct())
    signed = fresh_links.withColumn("n", F.lit(1)).unionByName(old_links.withColumn("n", F.lit(-1))).groupBy("src", "dst").agg(F.sum("n").alias("n")).filter("n <> 0")
    signed = cut(signed)

    # link targets whose redirects may end elsewhere, and those that are linked for the first time
    moved = cut(_through(touched, pages.unionByName(changed_pages)))
    known = resolved.join(moved, "title", "left_semi").select("title")
    first = fresh_links.select(F.col("dst").alias("title")).distinct().join(resolved.select("title"), "title", "left_anti")
    again = cut(known.unionByName(first).distinct())
    ends = cut(resolve_redirects(again, new_pages, HOPS).join(resolved.select("title", F.col("resolved").alias("was")), "title", "left"))
    elsewhere = cut(ends.filter("NOT (resolved <=> was)"))
    new_resolved = resolved.join(again, "title", "left_anti").unionByName(ends.select("title", "resolved"))

    # links that stay, but lead elsewhere now: all links to those targets but the ones that have just come
    to_moved = links.join(elsewhere.select(F.col("title").alias("dst")), "dst", "left_semi").join(old_links, ["src", "dst"], "left_anti").unionByName(old_links.join(fresh_links, ["src", "dst"], "left_semi").join(elsewhere.select(F.col("title").alias("dst")), "dst", "left_semi"))
    to_moved = cut(to_moved.select("src", "dst"))
    came, went = signed.filter("n > 0"), signed.filter("n < 0")
    delta = (
        _pairs(came, new_resolved).unionByName(_pairs(went, resolved))
        .unionByName(_pairs(to_moved.withColumn("n", F.lit(1)), new_resolved))
        .unionByName(_pairs(to_moved.withColumn("n", F.lit(-1)), resolved))
        .groupBy("src", "target").agg(F.sum("n").alias("d")).filter("d <> 0")
    )
    delta = cut(delta)

    # targets that open or close
    new_embedded = embedded.join(no_longer, "title", "left_anti").unionByName(newly).distinct()
    candidates = cut(touched.unionByName(newly).unionByName(no_longer).select(F.col("title").alias("target")).distinct())
    here = lambda p, e: _open(p.join(candidates.withColumnRenamed("target", "title"), "title", "left_semi"), e).withColumn("_o", F.lit(1))
    was, now = here(pages, embedded).withColumnRenamed("_o", "_was"), here(new_pages, new_embedded).withColumnRenamed("_o", "_now")
    flips = cut(candidates.join(was, "target", "left").join(now, "target", "left").na.fill(0, ["_was", "_now"]).filter("_was <> _now"))

    # all pairs that a link or a target touches, before and after
    old = pairs.join(delta.select("src", "target"), ["src", "target"], "left_semi").unionByName(pairs.join(flips, "target", "left_semi").select(*pairs.columns)).distinct()
    both = cut(old.join(delta, ["src", "target"], "full_outer").select("src", "target", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("d", F.lit(0)).alias("d")))
    named = both.select("target").distinct()
    open_before = _open(pages.join(named.withColumnRenamed("target", "title"), "title", "left_semi"), embedded).withColumn("_was", F.lit(1))
    open_after = _open(new_pages.join(named.withColumnRenamed("target", "title"), "title", "left_semi"), new_embedded).withColumn("_now", F.lit(1))
    judged = both.join(open_before, "target", "left").join(open_after, "target", "left").na.fill(0, ["_was", "_now"])
    change = F.when(F.col("n") + F.col("d") > 0, F.col("_now")).otherwise(0) - F.when(F.col("n") > 0, F.col("_was")).otherwise(0)
    by_source = cut(judged.groupBy("src").agg(F.sum(change).alias("delta")).filter("delta <> 0"))
    new_counts = cut(by_source.join(counts, "src", "left").select("src", (F.coalesce("n_links", F.lit(0)) + F.col("delta")).alias("n_links")))

    tx.delete("pages", touched)
    tx.append("pages", changed_pages)
    tx.delete("links", of_touched)
    tx.append("links", fresh_links)
    tx.upsert("resolved", ends.select("title", "resolved"))
    # pairs are kept by source: those of a source that has a changed pair are written again
    sources = cut(delta.select("src").distinct())
    kept = pairs.join(sources, "src", "left_semi").join(delta, ["src", "target"], "full_outer").select("src", "target", (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("n"))
    kept = cut(kept.filter("n > 0"))
    tx.delete("pairs", sources)
    tx.append("pairs", kept)
    tx.delete("embedded", no_longer.unionByName(newly))
    tx.append("embedded", newly.distinct())
    tx.delete("counts", new_counts.select("src"))
    tx.append("counts", new_counts.filter("n_links > 0"))
    return by_source


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(src, n_links) as it is kept; sources without open targets have no row."""
    return Store(spark, folder).read("counts")
