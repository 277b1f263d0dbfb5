"""Awkward documents, and brute-force versions of what the operators do."""

import random

LONG = "word " * 20_000


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like outputs."""
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, LONG, "en", "a", len(LONG)), (4, "same text of five words here", "en", "a", 1),
        (4, "same text of five words here", "en", "a", 1), (5, "same text of five words here", "de", "b", 1), (None, "no id", None, "b", 5),
        (6, "\U0001f600 é \u0000 x\ty", "fr", "", 9), (7, "  \n ", "en", "a", 4),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, schema)
    clash = "1 AS shard, 2 AS slot, 'x' AS labels, 0.5D AS score, 'f' AS fingerprint, 7 AS component_id, 'i' AS ids, 'd' AS decoded, 'w' AS words, 1 AS _key, 1 AS _row, 1 AS _n, 's' AS spans, 'u' AS url"
    return df.selectExpr("*", *clash.split(", "))


def empty(spark):
    return awkward(spark).limit(0)


def roots(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def prose(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))
