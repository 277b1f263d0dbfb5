"""Listings, samples and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower, first_sentence, is_redirect


def listing(left: DataFrame, right: DataFrame, key: str, title: str, counted: str, name: str, page: int, size: int) -> DataFrame:
    """One page of `left` by title with the number of its rows in `right`; pages count from 1.

    The right side is counted before it is joined, so a key with very many rows is one row.
    """
    counts = right.groupBy(key).agg(F.count(counted).alias(name))
    rows = left.select(key, title).join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.orderBy(title, key).offset((max(1, page) - 1) * size).limit(size)


def search_jobs(jobs: DataFrame, key: str, corpus: str, only: str | None, query: str | None) -> DataFrame:
    """Jobs of a corpus; `#12` or `12` is an id, anything else a pattern in which % and _ are wildcards."""
    out = jobs if only is None else jobs.filter(F.col(corpus) == only)
    if not query:
        return out
    number = query.removeprefix("#")
    if number.isdigit():
        return out.filter(F.col(key) == int(number))
    return out.filter(ascii_lower(F.col(key).cast("string")).like(f"%{query.lower()}%"))


def status_maps(items: DataFrame, job: str, status: str) -> DataFrame:
    """(job, statuses): a map from status to count; counted first, so a job's items never meet as rows."""
    counts = items.groupBy(job, status).agg(F.count("*").alias("n"))
    return counts.groupBy(job).agg(F.map_from_entries(F.collect_list(F.struct(status, "n"))).alias("statuses"))


def pattern_audit(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """(pattern, occurrences, articles, percent): all patterns counted in one pass over the texts."""
    counted = df.select(*(F.regexp_count(text, F.lit(p)).alias(n) for n, p in patterns.items()))
    sums = counted.agg(
        F.count("*").alias("_all"),
        *(F.sum(n).alias(f"_o_{n}") for n in patterns),
        *(F.count_if(F.col(n) > 0).alias(f"_a_{n}") for n in patterns),
    )
    rows = F.array(
        *(
            F.struct(F.lit(n).alias("pattern"), F.col(f"_o_{n}").alias("occurrences"), F.col(f"_a_{n}").alias("articles"), F.round(100.0 * F.col(f"_a_{n}") / F.col("_all"), 6).alias("percent"))
            for n in patterns
        )
    )
    return sums.select(F.inline(rows))


def exclusive_quantiles(df: DataFrame, value: Column, quantiles: list[float]) -> DataFrame:
    """(quantile, value) by the exclusive rule: position q * (n + 1), interpolated; exact.

    Values are counted first; what is ranked is the table of distinct values.
    """
    counts = df.select(value.cast("double").alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return counts.sparkSession.createDataFrame([], "quantile double, value double")
    places = []
    for q in quantiles:
        low = int(max(1, min(total - 1, q * (total + 1) // 1)))
        places.append((q, low, q * (total + 1) - low))
    inclusive = [(low - 1) / max(1, total - 1) for _, low, _ in places] + [low / max(1, total - 1) for _, low, _ in places]
    found = counts.agg(F.percentile("x", F.array(*(F.lit(x) for x in inclusive)), F.col("n")).alias("p"))
    k = len(places)
    rows = F.array(
        *(
            F.struct(F.lit(q).alias("quantile"), F.round(F.col("p")[i] + f * (F.col("p")[k + i] - F.col("p")[i]), 6).alias("value"))
            for i, (q, _, f) in enumerate(places)
        )
    )
    return found.select(F.inline(rows))


def top_share(df: DataFrame, value: Column, key: str, least: int, share: int = 10) -> DataFrame:
    """Mean and number of the largest 1/`share` of the values, `least` of them at least.

    The value at the border is a percentile of the values' counts; what lies above it is
    summed, and as many at the border are added as are wanted.
    """
    counts = df.select(value.alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = min(total, max(least, df.count() // share))
    place = (total - wanted) / (total - 1) if total > 1 else 0.0
    border = counts.agg(F.round(F.percentile("x", F.lit(place), F.col("n"))).alias("_border"))
    sums = counts.join(F.broadcast(border)).agg(
        F.sum(F.when(F.col("x") > F.col("_border"), F.col("x") * F.col("n"))).alias("s"),
        F.coalesce(F.sum(F.when(F.col("x") > F.col("_border"), F.col("n"))), F.lit(0)).alias("n"), F.first("_border").alias("b"),
    )
    mean = (F.coalesce("s", F.lit(0)) + (wanted - F.col("n")) * F.col("b")) / wanted
    return sums.select(F.round(mean, 6).alias("mean_length"), F.lit(wanted).cast("long").alias("n_rows"))


#: What is left in a chunk of picture links that were read wrongly.
PICTURE_NOISE = ["thumb|", "frame|", "frameless|", "upright|"]


def with_any(df: DataFrame, text: str, needles: list[str]) -> DataFrame:
    """Rows whose text holds any of `needles`, letters A-Z of either case."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | ascii_lower(F.col(text)).contains(needle.lower())
    return df.filter(hit)


def without_noise(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """`chunks` without those of any page that has a chunk with picture noise, so that the page is chunked anew."""
    noisy = with_any(chunks, text, PICTURE_NOISE).select(key).distinct()
    return chunks.join(noisy, key, "left_anti")


def _order(key: str, seed: str) -> Column:
    """The first 32 bits of a digest of seed and key, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")


def hashed_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A sample that depends on the keys and the seed alone, not on how the rows lie."""
    return df.filter(_order(key, str(seed)) < int(share * (1 << 32)))


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """`n` rows in an order that depends on the keys and the seed alone."""
    return df.orderBy(_order(key, str(seed)), key).limit(n)


def daily_pick(df: DataFrame, key: str, text: str, day: str, n: int, least_bytes: int = 3000) -> DataFrame:
    """`n` articles that are the same all day: of those that are long enough, no redirects and have a first sentence, the first by a digest of day and key."""
    eligible = (F.octet_length(text) >= least_bytes) & ~is_redirect(F.col(text)) & (first_sentence(F.col(text)) != "")
    return df.filter(eligible).orderBy(_order(key, day), key).limit(n)
