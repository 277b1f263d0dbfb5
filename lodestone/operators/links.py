"""The link graph: edges, redirects, and how many linked articles are not embedded yet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.cluster import ship
from lodestone.functions.text import is_excluded, is_redirect, links, normalize_title, redirect_target, strip
from lodestone.functions.wikitext import link_targets


def with_redirects(articles: DataFrame, text: str = "text") -> DataFrame:
    """`articles` with redirect_to and is_redirect, so that later steps never read the text."""
    return articles.withColumns({"redirect_to": redirect_target(F.col(text)), "is_redirect": is_redirect(F.col(text))})


def edges(articles: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """(src, dst, pos): article links in order of first occurrence, self-links left out."""
    found = articles.filter(~is_redirect(F.col(text))).select(
        F.col(title).alias("src"), F.posexplode(links(F.col(text), F.col(title))).alias("pos", "dst")
    )
    return found.select("src", "dst", "pos")


def accurate_edges(articles: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """(src, dst, pos) like `edges`, from closed links only: brackets are paired, and comments hold no links."""
    ship(articles.sparkSession)
    found = articles.filter(~is_redirect(F.col(text))).select(F.col(title).alias("src"), _targets(F.col(text)).alias("t"))
    named = F.transform("t", lambda t: normalize_title(strip(t)))
    kept = F.array_distinct(F.filter(named, lambda t: ~is_excluded(t) & (t != F.col("src"))))
    return found.select("src", F.posexplode(kept).alias("pos", "dst")).select("src", "dst", "pos")


@F.pandas_udf(ArrayType(StringType()))
def _targets(text: pd.Series) -> pd.Series:
    return text.map(lambda t: link_targets(t or ""))


def resolve_redirects(titles: DataFrame, articles: DataFrame, max_hops: int = 5) -> DataFrame:
    """(title, resolved): the article at the end of each title's redirect chain; null if it is missing, a cycle or too long.

    Hops are unrolled into joins on title of two narrow columns; Spark broadcasts the
    table where it is small and splits hot titles where it is not.
    """
    hop = articles.select(F.col("title").alias("_t"), F.col("redirect_to").alias("_to"))
    at = titles.select("title", F.col("title").alias("_at"), F.array("title").alias("_seen"), F.lit(None).cast("string").alias("resolved"), F.lit(False).alias("_done"))
    for _ in range(max_hops + 1):
        joined = at.join(hop, at["_at"] == hop["_t"], "left")
        found = F.col("_t").isNotNull()
        ends = found & F.col("_to").isNull()
        cycle = F.array_contains("_seen", F.col("_to"))
        open_ = ~F.col("_done")
        at = joined.select(
            "title",
            F.when(open_ & found & F.col("_to").isNotNull() & ~cycle, F.col("_to")).alias("_at"),
            F.when(open_ & F.col("_to").isNotNull(), F.concat("_seen", F.array("_to"))).otherwise(F.col("_seen")).alias("_seen"),
            F.when(open_ & ends, F.col("_at")).otherwise(F.col("resolved")).alias("resolved"),
            (F.col("_done") | ends | ~found | F.coalesce(cycle, F.lit(False))).alias("_done"),
        )
    return at.select("title", "resolved")


def unembedded_one_hop(edge_table: DataFrame, articles: DataFrame, embedded: DataFrame) -> DataFrame:
    """(src, n_links): resolved link targets that exist, are no redirects and are not embedded; the source itself left out."""
    targets = edge_table.select(F.col("dst").alias("title")).distinct()
    resolved = resolve_redirects(targets, articles)
    real = articles.filter(~F.col("is_redirect")).select("title")
    linked = (
        edge_table.join(resolved, edge_table["dst"] == resolved["title"])
        .select("src", F.coalesce("resolved", "dst").alias("title"))
        .filter("title <> src")
        .distinct()
        .join(real, "title", "left_semi")
        .join(embedded.select("title"), "title", "left_anti")
    )
    return linked.groupBy("src").agg(F.count("*").alias("n_links"))


def unembedded_two_hop(edge_table: DataFrame, articles: DataFrame, embedded: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, n_links) for `sources` (title): targets one and two links away that exist, are no redirects and are not embedded.

    Second-hop targets are not resolved; the first hop's links to itself and the origin
    do not count.
    """
    real = articles.filter(~F.col("is_redirect")).select("title")
    first = edge_table.join(sources.select(F.col("title").alias("src")), "src", "left_semi")
    resolved = resolve_redirects(first.select(F.col("dst").alias("title")).distinct(), articles)
    parents = (
        first.join(resolved, first["dst"] == resolved["title"])
        .select("src", F.coalesce("resolved", "dst").alias("title"))
        .filter("title <> src").distinct().join(real, "title", "left_semi")
    )
    second = (
        parents.select(F.col("src").alias("origin"), F.col("title").alias("src"))
        .join(edge_table.select("src", "dst"), "src")
        .select(F.col("origin").alias("src"), F.col("dst").alias("title"))
        .filter("title <> src").join(real, "title", "left_semi")
    )
    linked = parents.select("src", "title").unionByName(second.select("src", "title")).distinct()
    return linked.join(embedded.select("title"), "title", "left_anti").groupBy("src").agg(F.count("*").alias("n_links"))
