"""Search over chunks: BM25 postings, exact vector search, reciprocal rank fusion."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import tokens as T
from lodestone.functions.text import LOWER, UPPER, like_prefix

K1, B = 1.2, 0.75
_ASCII = str.maketrans(UPPER, LOWER)


def postings(df: DataFrame, key: str, text: Column, stemmed: bool = False) -> DataFrame:
    """(term, key, tf, length): one row for each distinct token of a document; rows without tokens have none."""
    listed = df.select(F.col(key), T.words(text).alias("w")).withColumn("length", F.size("w"))
    flat = listed.select(key, "length", F.explode("w").alias("term"))
    if stemmed:
        flat = flat.withColumn("term", T.porter("term"))
    return flat.groupBy("term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def trigram_postings(df: DataFrame, key: str, text: Column) -> DataFrame:
    listed = df.select(F.col(key), T.trigrams(text).alias("w"))
    return listed.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", key).agg(
        F.count("*").alias("tf"), F.first("length").alias("length")
    )


def corpus_stats(df: DataFrame, text: Column) -> DataFrame:
    """One row (n_docs, mean_length) over all documents, those without tokens included."""
    return df.select(F.size(T.words(text)).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean_length"))


def idf(n_docs: Column, df: Column) -> Column:
    """Floored at 1e-6 where a term stands in over half of the documents."""
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def bm25_term(weight: Column, tf: Column, length: Column, mean: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda w: w == term))


def bm25(df: DataFrame, key: str, text: Column, terms: list[str], all_terms: bool = True) -> DataFrame:
    """(key, score): documents that hold all `terms` (or any), best scores high.

    Only the query's tokens leave the scan: each document counts them in place, so
    the one shuffle is the two-number statistic of the corpus.
    """
    terms = list(dict.fromkeys(terms))
    words = T.words(text)
    counted = df.select(F.col(key), words.alias("_w")).select(
        key,
        F.size("_w").alias("_length"),
        *(_times(F.col("_w"), t).alias(f"_tf{i}") for i, t in enumerate(terms)),
    )
    stats = counted.agg(
        F.count("*").alias("_n"),
        F.avg("_length").alias("_mean"),
        *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))),
    )
    hit = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    match = hit[0]
    for h in hit[1:]:
        match = match & h if all_terms else match | h
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + bm25_term(idf(F.col("_n"), F.col(f"_df{i}")), F.col(f"_tf{i}"), F.col("_length"), F.col("_mean"))
    # the statistic is one row: it is read by every task as a broadcast
    return counted.filter(match).join(F.broadcast(stats)).select(key, score.alias("score"))


def l2_distance(vector: Column, query: Column) -> Column:
    squares = F.zip_with(vector, query, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def dense(df: DataFrame, key: str, vector: Column, query: list[float], k: int) -> DataFrame:
    """(key, distance) of the k nearest vectors, exactly; every partition keeps k rows and no more are shuffled."""
    point = F.array(*(F.lit(float(x)) for x in query))
    return df.select(F.col(key), l2_distance(vector, point).alias("distance")).orderBy("distance", key).limit(k)


def ranked(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """(key, rank) from 1; for candidate lists of bounded length."""
    return df.select(key, F.row_number().over(W.orderBy(*order)).alias("rank"))


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties stand as in the dense list, then as in the sparse one."""
    both = dense_hits.select(key, "rank", F.lit(0).alias("arm")).unionByName(sparse_hits.select(key, "rank", F.lit(1).alias("arm")))
    return both.groupBy(key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("first")
    )


def hybrid(
    found: DataFrame, key: str, vectors: DataFrame | None, vector: Column | None,
    query: list[float] | None, top_k: int = 5, candidates: int = 50, rrf_k: int = 60, sparse_order: str = "bm25",
) -> DataFrame:
    """(key, score, rank): the BM25 hits `found` (key, score) and the nearest vectors fused; without a query vector, hits alone."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be between 1 and 50")
    order = [F.desc("score"), key] if sparse_order == "bm25" else [key]
    sparse = ranked(found.orderBy(*order).limit(candidates), key, *order)
    if query is None or vectors is None:
        near = sparse.limit(0)
    else:
        near = ranked(dense(vectors, key, vector, query, candidates), key, "distance", key)
    fused = fuse(near, sparse, key, rrf_k)
    best = fused.orderBy(F.desc("score"), "first").limit(top_k)
    return best.select(key, "score", F.row_number().over(W.orderBy(F.desc("score"), "first")).alias("rank"))


def checked_request(query: str, corpus: str, top_k: int, corpora: list[str], most: int = 50) -> tuple[str, str, int]:
    """A request with its query trimmed; ValueError for a blank query or corpus and a `top_k` out of bounds, LookupError for an unknown corpus."""
    query, corpus = query.strip(), corpus.strip()
    if not query or not corpus:
        raise ValueError("query and corpus must not be blank")
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must be between 1 and {most}")
    if corpus not in corpora:
        raise LookupError(f"no corpus {corpus}")
    return query, corpus, top_k


def retrieve(
    query: str, search: Callable[[str], DataFrame], key: str, vectors: DataFrame | None, vector: Column | None,
    embed: Callable[[str], list[float]] | None, meta: DataFrame, top_k: int = 5, **given,
) -> tuple[DataFrame, bool]:
    """(hits with the columns of `meta` in order of rank, whether vectors were used) for free text; articles and papers alike.

    A query of white space finds nothing. Where the embedding fails the words alone
    decide. `search` gives (key, score) for a text, such as a search of a stored index.
    """
    query = query.strip()
    point = None
    if query and embed is not None and vectors is not None:
        try:
            point = embed(query)
        except OSError:
            point = None
    found = search(query)
    hits = hybrid(found, key, vectors if query else None, vector, point, top_k, **given)
    return hits.join(meta, key).orderBy("rank"), point is not None


def title_search(df: DataFrame, key: str, title: str, query: str, limit: int = 20) -> DataFrame:
    """(key, title, score): titles that hold `query` (three characters and more, any case) by trigram BM25; shorter ones by prefix."""
    if len(query) < 3:
        found = df.filter(like_prefix(F.col(title), query)).select(key, title, F.lit(0.0).alias("score"))
        return found.orderBy(title, key).limit(limit)
    low, wanted = F.lower(title), query.lower()
    n = F.greatest(F.char_length(low) - 2, F.lit(0))
    # a phrase occurs as often as the text splits at it, overlaps left aside
    tf = ((F.char_length(low) - F.char_length(F.replace(low, F.lit(wanted), F.lit("")))) / len(wanted)).cast("double")
    counted = df.select(key, title, n.alias("_n"), tf.alias("_tf"))
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), F.count_if(F.col("_tf") > 0).alias("_df"))
    score = bm25_term(idf(F.col("_docs"), F.col("_df")), F.col("_tf"), F.col("_n"), F.col("_mean"))
    return (
        counted.filter("_tf > 0").join(F.broadcast(stats)).select(key, title, score.alias("score")).orderBy(F.desc("score"), key).limit(limit)
    )


def per_group(hits: DataFrame, group: str, most: int, *order: Column | str) -> DataFrame:
    """At most `most` rows of each group, best first."""
    return hits.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def hashed_embedding(text: Column, dimension: int) -> Column:
    """A deterministic embedding that needs no model: signed counts of hashed tokens, scaled to length one.

    Tokens are sorted by their place first, so each is read once whatever the dimension.
    """
    at = F.transform(T.words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension)) * 2 + F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)))
    marks = F.sequence(F.lit(0).cast("bigint"), F.lit(2 * dimension).cast("bigint"))
    once = lambda value, then: F.transform(F.array(value), then)[0]

    def starts(v: Column) -> Column:
        """Where each number, a place and a sign, begins; every number is there once besides its tokens."""
        begins = F.transform(v, lambda x, i: F.when((i == 0) | (x != F.get(v, i - 1)), i))
        return F.filter(begins, lambda i: i.isNotNull())

    def signed(s: Column) -> Column:
        times = lambda k: F.get(s, k + 1) - F.get(s, k) - 1
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda p: (times(2 * p + 1) - times(2 * p)).cast("double"))

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return once(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))

    return once(once(once(F.array_sort(F.concat(at, marks)), starts), signed), scaled)


def one_dimension(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    """`df`; a vector of another dimension ends the job with an error when it is read."""
    wrong = F.concat(F.lit(f"a vector has not {dimension} components but "), F.size(vector).cast("string"))
    checked = F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(wrong))
    return df.withColumn(vector, checked)


def phrases(query: str) -> list[list[str]]:
    """Each word of a query as its tokens; a punctuated word is a phrase, a word without tokens is left out."""
    found = [re.findall("[a-z0-9\x80-\U0010ffff]+", w.replace('"', "").translate(_ASCII)) for w in query.split()]
    return [p for p in found if p]


def sparse_search(df: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """(key, score): documents that hold every word of a free query, by BM25 over its phrases; a word given twice counts twice.

    A query without tokens finds nothing.
    """
    wanted = phrases(query)
    if not wanted:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    words = T.words(text)
    # every token between spaces of its own, so that neighbouring matches do not share one
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    one = df.select(F.col(key), F.size(words).alias("_length"), spaced.alias("_s"))
    distinct = list(dict.fromkeys(map(tuple, wanted)))
    times = [F.regexp_count("_s", F.lit(re.escape(" " + "  ".join(p) + " "))) for p in distinct]
    counted = one.select(key, "_length", *(t.alias(f"_tf{i}") for i, t in enumerate(times)))
    stats = counted.agg(
        F.count("*").alias("_n"), F.avg("_length").alias("_mean"),
        *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(distinct))),
    )
    match, score = F.lit(True), F.lit(0.0)
    for i, p in enumerate(distinct):
        match = match & (F.col(f"_tf{i}") > 0)
        weight = idf(F.col("_n"), F.col(f"_df{i}")) * sum(tuple(w) == p for w in wanted)
        score = score + bm25_term(weight, F.col(f"_tf{i}"), F.col("_length"), F.col("_mean"))
    return counted.filter(match).join(F.broadcast(stats)).select(key, score.alias("score"))
