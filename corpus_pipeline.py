"""The corpus pipeline: documents in, ids of clean and unique documents out.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns the
next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, secrets, simhash_groups, toxicity
from lodestone.llm.common import remainder, shared_folder, table
from lodestone.llm.queries import RANKS
from lodestone.scratch import scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It learns from the labels of the documents at hand; without any, none goes. A null text
    is scored as the empty one; repeated rows go or stay together; an empty table gives no
    rows.
    """
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, classifier)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of similarity 0.8 and more the one of smallest id stays.

    Null and wordless texts are one group; ids that are null come last; of rows that agree
    in id and text one stays; an empty table gives no rows.
    """
    return simhash_groups.keep_one(docs, shingle=5, least=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    A null or empty text stays, and so does every document where the benchmark is empty;
    repeated rows go or stay together; an empty table gives no rows.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays.

    A null text stays null and an empty one empty; n_chars is counted anew where a text
    has changed; repeated rows stay, an empty table gives no rows.
    """
    # the document is one column while it is searched, so its columns may have any names
    found = secrets.find(docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("doc"), "text"))
    masked = secrets.redact(found)
    length = F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    new = {"text": F.col("text"), "n_chars": length}
    return masked.select(*(new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids binary): the packed ids, and digests of them and of the bytes they decode to.

    A null text is the empty one, which has no ids; one row for each row of `docs`.
    """
    ranks = public_tokenizers.path(RANKS)
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenize),
]

#: Fingerprints, the classifier and the merges are not SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again, so that a lost executor repeats no earlier stage.

    What a stage has put into the shared folder besides its result goes when it is written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
