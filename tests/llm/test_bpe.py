import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import bpe
from tests.llm.helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def wanted(codec):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary


def test_same_ids_as_replayed_merges(codec, wanted):
    rng = random.Random(3)
    texts = ["", " ", "a" * 30_000, "<|endoftext|>", "it's  we'll\n\n x", "ab" * 999]
    texts += ["".join(rng.choice("abcdeé 的ß1\n'sth") for _ in range(rng.randrange(1, 200))) for _ in range(400)]
    texts += ["".join(chr(rng.randrange(1, 0xD000)) for _ in range(60)) for _ in range(100)]
    for t in texts:
        packed = codec.encode_packed(t)
        assert np.frombuffer(packed, "<u4").tolist() == wanted(t)
        assert codec.decode_packed(packed) == t.encode()


def test_small_vocabularies():
    """Against merges replayed one by one, with vocabularies in which the longest token is often wrong."""
    rng = random.Random(5)
    for _ in range(60):
        known = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(known) < 30:  # as training would: a pair that stands side by side in some text
            names = {r: t for t, r in known.items()}
            enc = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=known, special_tokens={})
            ids = enc.encode_ordinary("".join(rng.choice("abc") for _ in range(40)))
            k = rng.randrange(len(ids) - 1) if len(ids) > 1 else 0
            pair = b"".join(names[i] for i in ids[k : k + 2])
            known.setdefault(pair, len(known))
        lines = b"\n".join(__import__("base64").b64encode(t) + b" %d" % r for t, r in known.items())
        own = bpe.Codec(lines, r".+")
        enc = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=known, special_tokens={})
        for _ in range(40):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
            assert np.frombuffer(own.encode_packed(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_awkward_rows(spark, wanted):
    df = awkward(spark)
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH)
    rows = out.select("doc_id", bpe.unpack("ids").alias("n"), "decoded").collect()
    texts = sorted((r.text or "") for r in df.collect())
    assert sorted(bytes(r.decoded).decode() for r in rows) == texts
    assert sorted(r.n for r in rows) == sorted(wanted(t) for t in texts)
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded=True)
    key = lambda r: (r.doc_id or 0, bytes(r.ids), bytes(r.decoded))
    assert sorted(map(key, both.collect())) == sorted(map(key, out.collect()))
    assert bpe.encode(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0
