"""The pipeline against its stages written out by brute force."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestone.llm import bpe, toxicity
from lodestone.llm.common import remainder, table
from tests.llm.helpers import awkward, roots
from tests.llm.test_texts import base

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def runs(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}


def plain(text):
    return "".join(c if c.isalnum() else " " for c in text.lower())


def mask(text):
    out, at = [], 0
    for start, _, end in base(text):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    scores = dict(toxicity.score(docs, model).collect())
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.5}
    sets = {i: runs(t) for i, t in texts.items()}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = set(roots(links, sets).values())
    items = [runs(plain(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i for i in kept if not any(len(x & runs(plain(texts[i]))) >= 0.8 * len(x) for x in items)}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.Codec(f.read(), public_tokenizers.PATTERN).ranks
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: encode(mask(texts[i])) for i in kept}


def test_stages_keep_the_columns(spark, sf_dir):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == awkward(spark).columns, name
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 3, 4, 6]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 5


def test_empty_tables_and_clashing_names(spark, sf_dir, tmp_path):
    """No documents give no rows; columns named like the stages' own are kept as they are."""
    docs = awkward(spark).withColumns({"_base": F.lit(1), "_more": F.lit(2), "_spans": F.lit("s"), "_base_spans": F.lit("b"), "_all": F.lit(3), "_doc": F.lit("d"), "node": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        docs = stage(spark, docs, sf_dir)
    assert docs.columns[-7:] == ["_base", "_more", "_spans", "_base_spans", "_all", "_doc", "node"]
    assert {tuple(r)[-7:] for r in docs.collect()} == {(1, 2, "s", "b", 3, "d", 4)}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from lodestone.llm import common

    class Session:
        class sparkContext:
            master = "spark://somewhere:7077"

        class conf:
            get = staticmethod(lambda name, other: other)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)
