import random
from collections import Counter

import zlib
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, sharding, urlfilter
from tests.llm.helpers import awkward, empty
from tests.oracle import spark_rows, sql_rows


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "x" * (i % 7), rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(3011)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sharding.interleave(df, 24, extra=sharding.size_and_checksum(), rows_per_bucket=3).collect()
    assert sorted(r.doc_id for r in got) == list(range(3011))
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(24):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    source = {i: s for i, _, s in rows}
    whole = Counter(source.values())
    for k in range(24):
        here = Counter(source[r.doc_id] for r in got if r.shard == k)
        assert all(abs(here[s] - n / 24) <= 2 for s, n in whole.items())
    assert all(r.size == r.doc_id % 7 + 8 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) for r in got)
    rows = sharding.interleave(awkward(spark), 24, extra=sharding.size_and_checksum()).collect()
    assert len(rows) == 9 and {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(8, 0)}
    assert sharding.interleave(empty(spark), 24).count() == 0


def test_order_of_shards(spark):
    """Shards and slots from ranks and fractions worked out in plain loops; repeated and null ids among the rows."""
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, i]), "x" * rng.randrange(40), rng.choice(["hot"] * 5 + ["a", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    extra = sharding.size_and_checksum()
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(20), F.col("doc_id"), *extra.values()), 1)
    given = df.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("s"), hashed.alias("h"), extra["size"].alias("size"), extra["text_crc32"].alias("c")).collect()
    none_first = lambda i: (i is not None, i)
    order = []
    for stratum in {r.s for r in given}:
        own = sorted((r for r in given if r.s == stratum), key=lambda r: (r.h, none_first(r.doc_id), r.size, r.c))
        order += [((k + 0.5) / len(own), r.s, r.h, none_first(r.doc_id), r.size, r.c, r.doc_id) for k, r in enumerate(own)]
    order.sort(key=lambda x: x[:6])
    wanted, n = Counter(), len(order)
    for place, x in enumerate(order):
        shard = place * 24 // n
        wanted[x[6], x[4], x[5], shard, place - -(-shard * n // 24)] += 1
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.interleave(df, 24, extra=extra, rows_per_bucket=2).collect())
    assert got == wanted


def glob_match(glob, text):
    """By recursion over the pattern."""
    states = {0}
    for c in [*text, None]:
        closed = set()
        for s in states:
            while s < len(glob) and glob[s] == 0x2A:
                closed.add(s)
                s += 1
            closed.add(s)
        if c is None:
            return len(glob) in closed
        states = {s if glob[s] == 0x2A else s + 1 for s in closed if s < len(glob) and glob[s] in (0x2A, 0x3F, c)}
    return False


def test_automaton():
    rng = random.Random(2)
    globs = []
    while len(globs) < 40:
        g = bytes(rng.choice(b"abab*?c") for _ in range(rng.randrange(1, 12)))
        if g.replace(b"*", b""):
            globs.append(g)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    fits = urlfilter.Automaton(globs).match(texts)
    for i, t in enumerate(texts):
        for k, g in enumerate(globs):
            assert fits[i, k] == glob_match(g, t), (g, t)


def test_urls(spark):
    cases = {
        "http://Example.ORG/es/x?q": ("example.org", "/es/x", "example.org/es/", "block"),
        "https://a.b.example.org/en/12#t": ("a.b.example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "https://org": ("org", "", None, "allow"),
        "x://a.com/fr/../org/": ("a.com", "/fr/../org/", "com/fr/", "allow"),
        "x://a.com/de/b": ("a.com", "/de/b", "com/de/", "block"),
        "x://a.com/deb": ("a.com", "/deb", None, "allow"),
        "x://ads.a.net/": ("ads.a.net", "/", None, "block"),
        "x://a.net/ads/1": ("a.net", "/ads/1", None, "block"),
        "x://a.net/q/.example.org/es/": ("a.net", "/q/.example.org/es/", None, "allow"),
        "no scheme.org/": ("", "", None, "block"),
        None: ("", "", None, "block"),
        "": ("", "", None, "block"),
        "x://é.org/" + "a" * 50_000: ("é.org", "/" + "a" * 50_000, "org/", "allow"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urlfilter.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, queries.ORACLE_SQL[name])


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
