"""Links, redirects, sections, chunks and markup over pages derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import html as H
from lodestone.functions import text as X
from lodestone.operators import chunks as C
from lodestone.operators import links as L
from lodestone.operators import queue as Q
from lodestone.sources.catalog import ordered_scan
from lodestone.plans.corpus import ARTICLES, EMBEDDED, RESOLVED, articles, edges, embedded, table, titles

ORACLE_SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_redirects(articles(spark, sf_dir))


@query(f"WITH {ARTICLES} SELECT page_id, is_redirect, redirect_to FROM linked")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select("page_id", "is_redirect", "redirect_to")


@query(f"WITH {ARTICLES} SELECT src, dst, pos FROM edges")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.edges(articles(spark, sf_dir))


@query(f"WITH {ARTICLES} SELECT src, dst, pos FROM edges")
def accurate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.accurate_edges(articles(spark, sf_dir))


@query(f"WITH {ARTICLES} SELECT page_id, revision_id FROM linked WHERE NOT is_redirect ORDER BY page_id LIMIT 100")
def ordered_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first articles in the order of their ids, as a job with a limit scans them."""
    return ordered_scan(titles(spark, sf_dir).filter("NOT is_redirect"), "page_id", 100).select("page_id", "revision_id")


@query(f"WITH RECURSIVE {ARTICLES}, {RESOLVED} SELECT l.title, r.resolved FROM linked l LEFT JOIN resolved r ON r.title = l.title")
def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = titles(spark, sf_dir)
    return L.resolve_redirects(pages.select("title"), pages)


_ONE_HOP = f"""{ARTICLES}, {RESOLVED}, {EMBEDDED}, parents AS (SELECT DISTINCT e.src, coalesce(r.resolved, e.dst) AS title
FROM edges e LEFT JOIN resolved r ON r.title = e.dst WHERE coalesce(r.resolved, e.dst) <> e.src AND coalesce(r.resolved, e.dst) IN (SELECT title FROM linked WHERE NOT is_redirect))"""


@query(f"WITH RECURSIVE {_ONE_HOP} SELECT src, count(*) AS n_links FROM parents WHERE title NOT IN (SELECT title FROM embedded) GROUP BY src")
def one_hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unembedded_one_hop(edges(spark, sf_dir), titles(spark, sf_dir), embedded(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ONE_HOP}, two AS (SELECT src, title FROM parents UNION SELECT p.src, e.dst FROM parents p JOIN edges e ON e.src = p.title
WHERE e.dst <> p.src AND e.dst IN (SELECT title FROM linked WHERE NOT is_redirect))
SELECT src, count(*) AS n_links FROM two WHERE title NOT IN (SELECT title FROM embedded) GROUP BY src""")
def two_hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = titles(spark, sf_dir)
    return L.unembedded_two_hop(edges(spark, sf_dir), pages, embedded(spark, sf_dir), pages.select("title"))


@query(f"""WITH {ARTICLES}, {EMBEDDED} SELECT l.title, CASE WHEN is_redirect THEN 'skipped_redirect' WHEN e.revision_id = l.revision_id THEN 'skipped_unchanged' ELSE 'complete' END AS status
FROM linked l LEFT JOIN embedded e ON e.title = l.title""")
def queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = titles(spark, sf_dir)
    items = pages.selectExpr("1 AS job_id", "title", "'queued' AS status", "0 AS hops_remaining", "0 AS force")
    return Q.settle(items, pages, embedded(spark, sf_dir)).select("title", "status")


@query(None)
def queue_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = titles(spark, sf_dir)
    items = narrow.selectExpr("page_id % 3 AS job_id", "title", "'queued' AS status", "CAST(2 AS BIGINT) AS hops_remaining", "0 AS force")
    return Q.drain(items, narrow, embedded(spark, sf_dir), edges(spark, sf_dir), 2)


@query(f"WITH {ARTICLES} SELECT page_id, [trim(x) FOR x IN regexp_extract_all(text, '(?i)\\[\\[Category:([^\\]|]+)', 1)] AS categories FROM articles")
def category_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("page_id", X.categories(F.col("text")).alias("categories"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'))) AS collapsed FROM documents")
def collapse_white_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.collapse_white_space(F.col("text"))).alias("collapsed"))


@query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(?s)\n=.*$', ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS x FROM documents),
s AS (SELECT doc_id, x, regexp_extract(x, '^(.*?\.) [A-Z]', 1) AS one FROM l),
o AS (SELECT doc_id, CASE WHEN one <> '' THEN one WHEN length(x) <= 240 THEN x ELSE regexp_replace(substr(x, 1, 240), ' [^ ]*$', '') || '…' END AS y FROM s)
SELECT doc_id, CASE WHEN length(y) < 10 THEN '' ELSE y END AS sentence FROM o""")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query(f"""WITH {ARTICLES} SELECT page_id, 'S' || (page_id % 4) AS section, md5(regexp_replace(substr(text, strpos(text, ' ==' || chr(10)) + 4), '^\\s+|\\s+$', '', 'g')) AS body_md5
FROM linked WHERE NOT is_redirect""")
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _linked(spark, sf_dir).filter("NOT is_redirect")
    parts = pages.select("page_id", F.explode(X.sections(F.col("text"))).alias("s"))
    return parts.filter("s.section IS NOT NULL").select("page_id", F.col("s.section").alias("section"), F.md5("s.body").alias("body_md5"))


@query("""WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 1599) // 1600))) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i AS chunk_index, md5(substr(text, (i * 1600 + 1)::BIGINT, 1600)) AS chunk_md5 FROM c""")
def hard_split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.posexplode(X.pack_paragraphs(F.col("text"), 1600)).alias("i", "x")).select(
        "doc_id", F.col("i").cast("long").alias("chunk_index"), F.md5("x").alias("chunk_md5")
    )


@query(None)
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return C.packed(d, "doc_id", "text", 600)


@query(None)
def article_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.article_chunks(articles(spark, sf_dir), "page_id", "title", "text")


@query(None)
def paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Lead\n\n## A\n\n"), "text", F.lit("\n\n### B\n\n"), "source").alias("md"))
    return C.paper_chunks(d, "doc_id", "md")


@query("""SELECT doc_id, 0 AS table_index, 'Table: Cap' AS heading, 0 AS row_index, 'Source: ' || source || ' | Lang: ' || lang AS row FROM documents
UNION ALL SELECT doc_id, 0, 'Table: Cap', 1, 'Source: n | Lang: ' || n_chars FROM documents""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    wiki = F.concat(F.lit("{| class=x\n|+ Cap\n! Source !! Lang\n|-\n| "), "source", F.lit(" || "), "lang", F.lit("\n|-\n| n || "), F.col("n_chars").cast("string"), F.lit("\n|}\n"), F.coalesce("text", F.lit("")))
    return C.table_rows(d.select("doc_id", wiki.alias("text")), "doc_id", "text")


@query("""SELECT doc_id, 0 AS box_index, 'Infobox: ' || source || ' — thing' AS heading, 0 AS field_index, 'name: Source' AS field FROM documents
UNION ALL SELECT doc_id, 0, 'Infobox: ' || source || ' — thing', 1, 'size: ' || n_chars FROM documents""")
def infobox_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    wiki = F.concat(F.lit("{{Infobox thing\n| name = [["), "source", F.lit("|Source]]\n| image = x.png\n| size = "), F.col("n_chars").cast("string"), F.lit("\n| empty =\n}}\n"), F.coalesce("text", F.lit("")))
    return C.infobox_fields(d.select("doc_id", "source", wiki.alias("text")), "doc_id", "text", "source")


@query(f"""WITH RECURSIVE {ARTICLES}, {RESOLVED}, t AS (SELECT DISTINCT e.src, coalesce(r.resolved, e.dst) AS title FROM edges e LEFT JOIN resolved r ON r.title = e.dst)
SELECT src AS source_title, title, 1 AS hops_remaining FROM t WHERE title <> src UNION ALL SELECT title, title, 0 FROM linked""")
def link_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article asks for its links: the queue's items with the ends of redirects as names."""
    pages = titles(spark, sf_dir)
    items = Q.link_items(pages.select(F.lit(1).alias("job_id"), "title"), edges(spark, sf_dir), pages, 1)
    return items.select("source_title", "title", "hops_remaining")


@query(f"""WITH RECURSIVE {_ONE_HOP}, n AS (SELECT src, count(*) AS k FROM parents WHERE title NOT IN (SELECT title FROM embedded) GROUP BY src)
SELECT e.title, (l.page_id % 2 = 0)::INT AS links_embedded, CASE WHEN l.page_id % 2 = 0 THEN coalesce(k, 0) ELSE -1 END AS n_links
FROM embedded e JOIN linked l ON l.title = e.title LEFT JOIN n ON n.src = e.title""")
def link_counts_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded articles whose items are done get their flags and link counts anew."""
    pages = titles(spark, sf_dir)
    counts = L.unembedded_one_hop(edges(spark, sf_dir), pages, embedded(spark, sf_dir))
    meta = embedded(spark, sf_dir).select("title", F.lit(0).alias("links_embedded"), F.lit(0).alias("links_embedded_2hop"), F.lit(-1).cast("long").alias("n_links"), F.lit(-1).cast("long").alias("n_links_2hop"))
    items = pages.select(F.col("title").alias("source_title"), F.when(F.col("page_id") % 2 == 0, "complete").otherwise("queued").alias("status"), F.lit(0).alias("hops_remaining"))
    return Q.finalise(meta, items, counts, counts.limit(0)).select("title", "links_embedded", "n_links")


@query(None)
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = articles(spark, sf_dir)
    return pages.select("page_id", F.md5(X.strip_markup(F.col("text"))).alias("plain_md5"))


@query(None)
def markup_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = articles(spark, sf_dir)
    return pages.select("page_id", F.md5(X.markup_to_html(F.col("text"))).alias("html_md5"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<li\\b')) AS items, len(regexp_extract_all(html, '(?i)<a\\s')) AS links FROM pages")
def html_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    count = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return p.select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), count(r"(?i)<li\b").alias("items"), count(r"(?i)<a\s").alias("links"))


@query(None)
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.html_to_markdown(F.col("html")).alias("markdown"))


@query("SELECT page_id, '/wiki/' || replace(url_encode(replace(replace(url, '://', '/'), ' ', '_')), '%2F', '/') AS path FROM pages")
def article_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit("/wiki/"), X.article_path(F.replace("url", F.lit("://"), F.lit("/")))).alias("path"))
