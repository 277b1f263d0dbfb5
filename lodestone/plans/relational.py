"""Lookups, joins, aggregates, paging, merges, queues and reports over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import merges as M
from lodestone.operators import queue as Q
from lodestone.operators import reports as P
from lodestone.plans.corpus import built_once, embedded, table
from lodestone.scratch import shared_folder
from lodestone.sources.paging import page, write_pages

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None):
    """Registers a query and the SQL for its rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey = 7").select("c_name", "c_acctbal")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 30 AND length(p_name) > 10 AND p_type IS NOT NULL")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.filter("p_size >= 30 AND char_length(p_name) > 10 AND p_type IS NOT NULL").select("p_partkey", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def in_and_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kept = F.col("o_orderstatus").isin("O", "F") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return o.filter(kept).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND (CAST(o_orderkey AS VARCHAR) LIKE '%1_2%')")
def job_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search_jobs(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", "O", "1_2").select("o_orderkey")


@query("SELECT doc_id, substr(text, 1, 100) AS prefix, length(text) AS n_points, octet_length(encode(text)) AS n_bytes FROM documents")
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring("text", 1, 100).alias("prefix"),
        F.char_length("text").cast("long").alias("n_points"), F.octet_length("text").cast("long").alias("n_bytes"),
    )


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity > 25").agg(F.count("*").alias("n"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS job_id, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS job_id, count(*) AS items, count(DISTINCT event_type) AS statuses FROM events GROUP BY 1")
def job_status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = P.status_maps(table(spark, sf_dir, "events"), "user_id", "event_type")
    items = F.aggregate(F.map_values("statuses"), F.lit(0).cast("long"), lambda a, x: a + x)
    return maps.select(F.col("user_id").alias("job_id"), items.alias("items"), F.size("statuses").cast("long").alias("statuses"))


@query("SELECT max(o_orderkey) AS max_key, min(o_orderkey) AS min_key FROM orders WHERE o_totalprice >= 3000")
def max_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_totalprice >= 3000").agg(F.max("o_orderkey").alias("max_key"), F.min("o_orderkey").alias("min_key"))


@query("SELECT user_id, max(event_id) AS latest, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.struct("event_id", "event_type")).alias("m")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", F.col("m.event_id").alias("latest"), F.col("m.event_type").alias("status"))


@query("SELECT event_type, min(event_id) AS head, arg_min(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("event_id", "user_id")).alias("m")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(first).select("event_type", F.col("m.event_id").alias("head"), F.col("m.user_id").alias("user_id"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id").orderBy(F.desc("event_id")).limit(1)


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY 1, 2 ORDER BY c_name, c_custkey LIMIT 50 OFFSET 100""")
def listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.listing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_name", "o_orderkey", "n_orders", page=3, size=50)


def _page_of_customers(spark: SparkSession, sf_dir: str, number: int) -> DataFrame:
    """A page of customers with their orders counted, from files in the order of their names."""

    def build() -> str:
        path = f"{shared_folder(spark)}/customers-{uuid.uuid4().hex}"
        counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
        rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counts, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
        write_pages(rows, path, ["c_name", "c_custkey"], rows_per_file=1_000)
        return path

    return page(spark, built_once(spark, sf_dir, "customer_pages", build, ["customer", "orders"]), ["c_name", "c_custkey"], number, 50)


@query("""SELECT * FROM (SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)
QUALIFY row_number() OVER (ORDER BY c_name, c_custkey) > (SELECT (count(*) - 1) // 50 * 50 FROM customer)""")
def last_listing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of the listing: as cheap as the first."""
    return _page_of_customers(spark, sf_dir, -(-table(spark, sf_dir, "customer").count() // 50))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def two_hop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("suppliers"))


@query("SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY 1, 2")
def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def grouped_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("turn", "role")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(listed.alias("l"))
    return c.select("conv_id", F.array_join(F.transform("l", lambda x: x["role"]), ",").alias("roles"))


# a snapshot of documents against a feed that skips, changes and adds rows

_TARGET = "target AS (SELECT doc_id AS page_id, doc_id % 5 AS revision_id, md5(coalesce(text, '')) AS body, 1 AS created FROM documents WHERE doc_id % 7 <> 0)"
_FEED = "feed AS (SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 ELSE doc_id % 4 END AS revision_id, md5(coalesce(text, '') || '!') AS body, 2 AS created FROM documents WHERE doc_id % 11 <> 0)"
_ACTED = f"{_TARGET}, {_FEED}, acted AS (SELECT f.*, t.revision_id AS old, CASE WHEN t.page_id IS NULL THEN 'insert' WHEN t.revision_id = f.revision_id THEN 'skip' ELSE 'update' END AS action FROM feed f LEFT JOIN target t ON f.page_id = t.page_id)"


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0")
    return d.selectExpr("doc_id AS page_id", "doc_id % 5 AS revision_id", "md5(coalesce(text, '')) AS body", "1 AS created")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0")
    return d.selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 ELSE doc_id % 4 END AS revision_id", "md5(concat(coalesce(text, ''), '!')) AS body", "2 AS created")


@query(f"WITH {_ACTED} SELECT page_id, revision_id, action FROM acted")
def cdc_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.refresh_actions(_target(spark, sf_dir), _feed(spark, sf_dir)).select("page_id", "revision_id", "action")


@query(f"WITH {_ACTED} SELECT count(*) AS scanned, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'update') AS updated, count(*) FILTER (action = 'insert') AS inserted, count(*) FILTER (action = 'update') AS archived FROM acted")
def cdc_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.counters(M.refresh_actions(_target(spark, sf_dir), _feed(spark, sf_dir)))


@query(f"WITH {_ACTED} SELECT page_id, revision_id, body, created FROM acted WHERE action = 'insert' UNION ALL SELECT t.page_id, CASE WHEN a.action = 'update' THEN a.revision_id ELSE t.revision_id END, CASE WHEN a.action = 'update' THEN a.body ELSE t.body END, t.created FROM target t LEFT JOIN acted a ON a.page_id = t.page_id")
def cdc_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.refresh(_target(spark, sf_dir), _feed(spark, sf_dir), kept=["created"])[0]


@query(f"WITH {_ACTED} SELECT t.* FROM target t JOIN acted a ON a.page_id = t.page_id WHERE a.action = 'update'")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.refresh(_target(spark, sf_dir), _feed(spark, sf_dir))[1]


@query(f"WITH {_ACTED} SELECT CASE action WHEN 'insert' THEN 'inserted' WHEN 'update' THEN 'updated' ELSE 'skipped' END AS action, count(*) AS n FROM acted GROUP BY 1")
def paper_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, feed = (f(spark, sf_dir).selectExpr("page_id AS id", "revision_id AS oai_datestamp", "body") for f in (_target, _feed))
    return M.paper_actions(papers, feed).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_TARGET}, {_FEED} SELECT * FROM target WHERE page_id NOT IN (SELECT page_id FROM feed) UNION ALL SELECT * FROM feed")
def upsert_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.upsert(_target(spark, sf_dir), _feed(spark, sf_dir), "page_id")


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber, arg_max(l_partkey, l_linenumber) AS l_partkey FROM lineitem GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lines of one number the first in the table, which only its files tell."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "_metadata.file_path", "_metadata.row_index")
    return M.last_wins(lines, "l_orderkey", "l_linenumber", "file_path", "row_index").drop("file_path", "row_index")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return M.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("""SELECT d.doc_id AS page_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN d.doc_id * 10 + d.doc_id % 3 = l.doc_id * 10 + l.doc_id % 2 THEN 'skipped' ELSE 'updated' END AS state
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def embedded_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").selectExpr("doc_id AS page_id", "doc_id * 10 + doc_id % 3 AS revision_id")
    return M.embedded_state(pages, embedded(spark, sf_dir), "page_id", "revision_id")


@query("SELECT source, count(*) AS unembedded FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source")
def unembedded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("unembedded"))


# events as queue items: users are jobs, event types titles

_ITEMS = "items AS (SELECT user_id AS job_id, event_type AS title, CASE WHEN min(event_id) % 2 = 0 THEN 'queued' ELSE 'complete' END AS status, 0 AS hops_remaining, 0 AS force FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_id % 3 = 0").groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("title")).agg(F.min("event_id").alias("m"))
    return e.selectExpr("job_id", "title", "CASE WHEN m % 2 = 0 THEN 'queued' ELSE 'complete' END AS status", "0 AS hops_remaining", "0 AS force")


@query(f"""WITH {_ITEMS}, new AS (SELECT user_id AS job_id, event_type AS title, max(event_id % 3)::INT AS h, max(event_id % 2)::INT AS f FROM events GROUP BY 1, 2)
SELECT coalesce(i.job_id, n.job_id) AS job_id, coalesce(i.title, n.title) AS title, coalesce(status, 'queued') AS status,
CASE WHEN coalesce(status, 'queued') = 'queued' THEN greatest(coalesce(hops_remaining, h), coalesce(h, hops_remaining)) ELSE hops_remaining END AS hops_remaining,
CASE WHEN coalesce(status, 'queued') = 'queued' THEN greatest(coalesce(force, f), coalesce(f, force)) ELSE force END AS force
FROM items i FULL JOIN new n ON i.job_id = n.job_id AND i.title = n.title""")
def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_type AS title", "CAST(event_id % 3 AS INT) AS hops_remaining", "CAST(event_id % 2 AS INT) AS force")
    return Q.enqueue(_items(spark, sf_dir), new)


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'failed' ELSE event_type END AS status FROM events")
def queue_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_status = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "view", "in_progress").otherwise(F.col("event_type"))
    return Q.recover(table(spark, sf_dir, "events").select("event_id", as_status.alias("status")))


@query("""SELECT 'junk' AS pattern, sum(len(regexp_extract_all(text, '[%$#&*]{3}'))) AS occurrences, count(*) FILTER (regexp_matches(text, '[%$#&*]{3}')) AS articles, round(100.0 * count(*) FILTER (regexp_matches(text, '[%$#&*]{3}')) / count(*), 6) AS percent FROM documents
UNION ALL SELECT 'shout', sum(len(regexp_extract_all(text, '[A-Z]{4}'))), count(*) FILTER (regexp_matches(text, '[A-Z]{4}')), round(100.0 * count(*) FILTER (regexp_matches(text, '[A-Z]{4}')) / count(*), 6) FROM documents
UNION ALL SELECT 'digits', sum(len(regexp_extract_all(text, '[0-9]+'))), count(*) FILTER (regexp_matches(text, '[0-9]+')), round(100.0 * count(*) FILTER (regexp_matches(text, '[0-9]+')) / count(*), 6) FROM documents""")
def pattern_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pattern_audit(table(spark, sf_dir, "documents"), "text", {"junk": "[%$#&*]{3}", "shout": "[A-Z]{4}", "digits": "[0-9]+"})


@query("""WITH n AS (SELECT length(text) AS x, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS c FROM documents),
p AS (SELECT unnest([0.5, 0.95, 0.99]) AS q), k AS (SELECT q, greatest(1, least(max(c) - 1, floor(q * (max(c) + 1))))::BIGINT AS lo, q * (max(c) + 1) - greatest(1, least(max(c) - 1, floor(q * (max(c) + 1)))) AS f FROM n, p GROUP BY q)
SELECT q::DOUBLE AS quantile, round((a.x + f * (b.x - a.x))::DOUBLE, 6) AS value FROM k JOIN n a ON a.r = k.lo JOIN n b ON b.r = k.lo + 1""")
def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exclusive_quantiles(table(spark, sf_dir, "documents"), F.char_length("text"), [0.5, 0.95, 0.99])


@query("WITH t AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS r, count(*) OVER () AS c FROM documents) SELECT round(avg(n), 6) AS mean_length, count(*) AS n_rows FROM t WHERE r <= greatest(10, c // 10)")
def top_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_share(table(spark, sf_dir, "documents"), F.char_length("text"), "doc_id", 10)


@query("SELECT DISTINCT source FROM documents WHERE text LIKE '%###%' OR text LIKE '%$$$%' OR text LIKE '%&&&%' OR text LIKE '%***%'")
def noise_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_any(table(spark, sf_dir, "documents"), "text", ["###", "$$$", "&&&", "***"]).select("source").distinct()


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS elapsed FROM (SELECT event_id, (event_id * 7919) % 20000 AS s FROM events)")
def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.elapsed((F.col("event_id") * 7919) % 20000).alias("elapsed"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("SELECT event_id, list_sort(json_keys(props)) AS keys FROM events")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(F.json_object_keys("props")).alias("keys"))


@query("SELECT n_nationkey, min(s_suppkey) AS first_supplier, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def count_after_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_nationkey").agg(F.min("s_suppkey").alias("first_supplier"), F.count("s_suppkey").alias("suppliers"))


@query("SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0)")
def rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their source: a source with one noisy chunk loses all."""
    noisy = F.when(F.col("doc_id") % 97 == 0, " [[x.png|THUMB|y]]").otherwise(" thumb, frame")
    chunks = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\|", "/"), noisy).alias("text"))
    return P.without_noise(chunks, "source", "text").select("doc_id")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 5")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").orderBy("doc_id").limit(5)


_ORDER = "('0x' || substr(md5('{}:' || doc_id), 1, 8))::BIGINT"


@query(f"SELECT doc_id FROM documents WHERE {_ORDER.format(7)} < 858993459")
def hashed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hashed_sample(table(spark, sf_dir, "documents"), "doc_id", 0.2, 7).select("doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {_ORDER.format(11)}, doc_id LIMIT 20")
def random_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.random_rows(table(spark, sf_dir, "documents"), "doc_id", 20, 11).select("doc_id")


@query(rf"""WITH l AS (SELECT *, trim(regexp_replace(regexp_replace(text, '(?s)\n=.*$', ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, n_chars FROM l WHERE octet_length(encode(text)) >= 3000 AND NOT regexp_matches(text, '(?i)^\s*#\s*REDIRECT\s*\[\[')
AND length(CASE WHEN regexp_extract(x, '^(.*?\.) [A-Z]', 1) <> '' THEN regexp_extract(x, '^(.*?\.) [A-Z]', 1) ELSE x END) >= 10 ORDER BY {_ORDER.format('2026-01-31')}, doc_id LIMIT 2""")
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_pick(table(spark, sf_dir, "documents"), "doc_id", "text", "2026-01-31", 2).select("doc_id", "n_chars")


@query("SELECT event_id, strftime(to_timestamp(event_id * 86399), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def unix_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.from_unix(F.col("event_id") * 86399).alias("at"))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS digest FROM documents")
def sha1_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 37")
def job_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.search_jobs(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", None, "#37").select("o_orderkey")


_JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS corpus, CASE o_orderstatus WHEN 'F' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'complete' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS cancel_requested FROM orders)"""


@query(f"""WITH {_JOBS}, n AS (SELECT corpus, min(job_id) FILTER (status = 'queued' AND cancel_requested = 0) AS first, count(*) FILTER (status = 'running') AS running FROM jobs GROUP BY 1)
SELECT job_id, CASE WHEN running = 0 AND job_id = first THEN 'running' ELSE status END AS status, coalesce(running = 0 AND job_id = first, false)::INT AS started FROM jobs JOIN n USING (corpus)""")
def queue_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs of their customers: the oldest queued one starts where none runs."""
    jobs = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("complete")
    asked = F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)
    jobs = jobs.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("corpus"), status.alias("status"), asked.alias("cancel_requested"), F.lit(None).cast("string").alias("started_at"))
    return Q.promote(jobs, F.lit("now")).select("job_id", "status", F.coalesce((F.col("started_at") == "now").cast("int"), F.lit(0)).alias("started"))


@query("""SELECT event_id AS item_id, CASE WHEN event_id % 3 = 0 THEN 'complete' WHEN event_id % 3 = 1 THEN 'in_progress' ELSE 'queued' END AS status,
CASE WHEN event_id % 3 = 0 THEN user_id WHEN event_id % 2 = 0 THEN 1 END AS chunk_count, event_id % 3 = 0 AS done FROM events""")
def item_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queue items: a third gets a result that ends it, a third one that does not."""
    events = table(spark, sf_dir, "events").withColumn("item_id", F.col("event_id"))
    none = F.lit(None).cast("string")
    items = events.select("item_id", F.lit("queued").alias("status"), F.when(F.col("event_id") % 2 == 0, F.lit(1).cast("long")).alias("chunk_count"), none.alias("error_message"), none.alias("finished_at"))
    complete = F.col("event_id") % 3 == 0
    results = events.filter("event_id % 3 <> 2").select("item_id", F.when(complete, "complete").otherwise("in_progress").alias("status"), F.when(complete, F.col("user_id")).alias("chunk_count"), none.alias("error_message"))
    return Q.finish(items, results, F.lit("now")).select("item_id", "status", "chunk_count", F.coalesce(F.col("finished_at") == "now", F.lit(False)).alias("done"))


ORACLE_SQL = SQL


@query("""SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 1440), '%-d %b %Y %H:%M UTC') AS started,
CASE WHEN o_orderkey % 7 = 0 THEN '—' WHEN o_orderkey % 7 = 1 THEN 'soon' ELSE strftime(o_orderdate::TIMESTAMP + to_minutes(o_orderkey % 1440), '%Y-%m-%d %H:%M') END AS embedded FROM orders""")
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as times of jobs, as they are shown; some are missing and some are no times."""
    orders = table(spark, sf_dir, "orders")
    minutes = F.col("o_orderkey") % 1440
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    iso = F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T"), two(minutes / 60), F.lit(":"), two(minutes % 60), F.lit(":09"))
    given = F.when(F.col("o_orderkey") % 7 == 1, "soon").when(F.col("o_orderkey") % 7 != 0, iso)
    return orders.select("o_orderkey", X.started_display(iso).alias("started"), X.embedded_display(given).alias("embedded"))
