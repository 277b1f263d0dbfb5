"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, capfilter, decontaminate, filteraudit, langid, licenses, secrets, sharding, simhash, suffixdedup, toxicity, urlfilter, vectorcodes
from lodestone.llm.common import remainder, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    classifier = toxicity.fit(documents, labels, remainder(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(documents, classifier).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(secrets.named(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.named(F.col("spans")).alias("spans"),
    )


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    placed = sharding.interleave(documents, 24, extra=sharding.size_and_checksum())
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents, remainder(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return langid.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_cap_filters": op4_cap_filters,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_stratified_shards": op8_stratified_shards,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_suffix_dedup": op13_suffix_dedup,
}


def _globs_sql() -> str:
    """The block globs as one DuckDB condition over host, path and rest."""
    tests = []
    for spec in urlfilter.BLOCK_GLOBS:
        part, _, glob = spec.partition(":")
        pattern = re.escape(glob).replace(r"\*", "(.|\n)*").replace(r"\?", "(.|\n)")
        pattern = rf"(.*\.)?{pattern}\..*" if part == "host" else pattern
        tests.append(f"regexp_full_match({part}, '{pattern}')")
    return " OR ".join(tests)


def _rules_sql() -> str:
    """The longest site rule that fits, as a CASE over host and path."""
    whens = []
    for text, _ in sorted(urlfilter.SITE_RULES, key=lambda r: -len(r[0])):
        host, slash, path = text.partition("/")
        whens.append(f"WHEN ends_with('.' || host, '.{host}') AND starts_with(path, '{slash + path}') THEN '{text}'")
    return f"CASE {' '.join(whens)} END"


#: one round of codebooks over vector parts `p`: the assignment by entries `c{r}`, and the entries that follow
_ROUND = """d{r} AS MATERIALIZED (SELECT p.vec_id, p.part, arg_min(struct_pack(e := e, d := d), struct_pack(d := d, e := e)) AS best FROM
  (SELECT p.vec_id, p.part, c.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, c.c)])::BIGINT AS d FROM p JOIN c{r} c USING (part)) p GROUP BY ALL),
m{r} AS (SELECT part, e, list(floor(s::DOUBLE / n)::BIGINT ORDER BY j) AS c FROM (SELECT part, best.e AS e, j, sum(x[j]) AS s, count(*) AS n
  FROM d{r} JOIN p USING (vec_id, part), range(1, 1 + (SELECT w FROM dim)) t(j) GROUP BY ALL) GROUP BY part, e),
c{s} AS MATERIALIZED (SELECT part, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, e))"""

_VERDICTS = " ".join(f"WHEN rule = '{t}' THEN '{v}'" for t, v in urlfilter.SITE_RULES)

ORACLE_SQL: dict[str, str] = {
    "op4_cap_filters": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98 AND NOT isnan(list_cosine_similarity(a.e, b.e))),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, p.y FROM r JOIN p ON p.x = r.t),
c AS (SELECT s, min(t) AS m FROM r GROUP BY s), n AS (SELECT x, count(*) AS k FROM p GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON s = vec_id LEFT JOIN n ON x = vec_id""",
    "op9_url_filter": rf"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^?#]*(.*)$', 1) AS rest FROM u),
j AS (SELECT *, {_rules_sql()} AS rule FROM h)
SELECT page_id, host, path, rule, CASE {_VERDICTS} WHEN {_globs_sql()} THEN 'block' WHEN host = '' THEN 'block' ELSE 'allow' END AS verdict FROM j""",
    "op11_filter_audit": r"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, [v FOR v IN string_split_regex(x, '[\x20\x09-\x0D]+') IF v <> ''] AS ws FROM t),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 3 * length(x))::INT
  + 8 * regexp_matches(x, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY x))::INT AS mask, coalesce(good, 0) AS good, coalesce(tox, 0) AS tox FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(tox) AS tox FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM f a, f b, f c, f d, f e WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step::INT AS step, (SELECT b FROM f WHERE l = filter_order[step]) AS own, list_sum([CASE ch WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END
  FOR ch IN string_split(filter_order[:step], '')])::INT AS after FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & after = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & after = own), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & after <> own), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & after = own), 0)::BIGINT AS good_lost, coalesce(sum(tox) FILTER (mask & after = own), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
    "op12_vector_codes": f"""WITH k AS MATERIALIZED (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
dim AS (SELECT max(len(v)) // 16 AS w FROM k), p AS MATERIALIZED (SELECT vec_id, part, v[part * w + 1:(part + 1) * w] AS x FROM k, dim, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, e, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)) USING (vec_id)),
{_ROUND.format(r=0, s=1)},
{_ROUND.format(r=1, s=2)},
{_ROUND.format(r=2, s=3)},
f AS (SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM d2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN k USING (vec_id), h""",
}
