import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import capfilter, components, simhash, simhash_groups
from lodestone.llm.common import told_apart
from tests.llm.helpers import awkward, empty, prose, roots


def print_of(text, n):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_fingerprints_and_links(spark, segments):
    rng = random.Random(segments)
    words = [f"w{i}" for i in range(300)]
    texts = [prose(rng, rng.randrange(3, 60), words) for _ in range(60)]
    for t in list(texts):
        w = t.split()
        w[rng.randrange(len(w))] = "Other"
        texts.append(" ".join(w))
    texts += ["", "x", "X", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df, shingle=4, radius=4, segments=segments).collect()}
    prints = {i: print_of(t, 4) for i, t in enumerate(texts)}
    assert all(got[i].fingerprint % (1 << 64) == p for i, p in prints.items())
    links = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == roots(links, prints)


def test_every_distance_is_found(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(200)]
    prints = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 6))) for b in base]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")
    for limit in (20_000, 3):
        found = components.connected_components(simhash.links(df, 4, 3, bucket_limit=limit))
        got = dict(found.collect())
        links = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 4]
        assert {p: got.get(p, p) for p in signed} == roots(links, signed)


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(awkward(spark), shingle=4).collect()
    assert len(rows) == 9
    zero = {r.doc_id: r.component_id for r in rows if r.fingerprint == 0}
    assert zero == {1: 1, 2: 1, 7: 1}
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (700, 700)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = dict(components.connected_components(df).collect())
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500, 502: 500}


def brute(rows):
    unit, ids = {}, []
    for k, (i, v, label) in enumerate(rows):
        ids.append(i)
        if v is None or label is None or any(x is None for x in v) or not np.isfinite(v).all() or not np.any(v):
            continue
        unit[k] = (np.array(v) / np.linalg.norm(v), label)
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    n = [sum(k in x for x in links) for k in range(len(rows))]
    root = roots([(ids[a], ids[b]) for a, b in links], ids)
    return sorted((i, c, root[i]) for i, c in zip(ids, n, strict=True))


@pytest.mark.parametrize("limit", [4_000, 7])
def test_cap_filters(spark, limit):
    rng = np.random.default_rng(limit)
    centres = rng.standard_normal((40, 64))
    rows, i = [], 0
    for k, c in enumerate(centres):
        for _ in range(rng.integers(1, 9)):
            rows.append((i, (c + rng.standard_normal(64) * rng.choice([0, 0.05, 0.12, 0.14])).astype(np.float32).tolist(), int(k % 3)))
            i += 1
    rows += [(i, rows[0][1], rows[0][2]), (i + 1, rows[0][1], None), (i + 2, None, 1), (i + 3, [0.0] * 64, 1), (i + 4, [float("nan")] * 64, 1), (i + 5, [None] + [1.0] * 63, 1), (i + 6, [1.0] * 10, 1), (i + 7, [3.0] * 10, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in capfilter.near_duplicates(df, bucket_limit=limit).collect())
    assert got == brute(rows)
    assert capfilter.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dimension", [8, 16, 64, 384])
@pytest.mark.parametrize("codewords", [16, 64, 256, 1024])
def test_recall_of_filters(dimension, codewords):
    """At the threshold itself, where it is lowest: pairs that share a filter, against all pairs, at any number of directions."""
    x, y = capfilter.pairs_at(0.98, dimension, 2000, 9)
    assert np.allclose((x * y).sum(axis=1), 0.98)
    words, rotations = capfilter.rotations_for(dimension, codewords, 0.98, 6, 4)
    assert words <= codewords and 4 <= rotations <= 12
    assert capfilter.met(capfilter.ProductCode(dimension, words, 4, rotations), x, y, 6).mean() >= 0.995


def test_decoding_gives_the_highest_filters():
    """Against the products with every filter."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 10))
    code = capfilter.ProductCode(10, 5, 3, rotations=2)
    got = code.decode(x, 6)
    for i in range(20):
        wanted = []
        for r in range(2):
            blocks = (x[i] @ code.turns[r]).reshape(4, -1)
            s = [code.codes[r][b] @ blocks[b] for b in range(4)]
            every = (s[0][:, None, None, None] + s[1][None, :, None, None] + s[2][None, None, :, None] + s[3]).ravel()
            wanted += (np.argsort(-every)[:6] + r * 5**4).tolist()
        assert got[i].tolist() == sorted(wanted)


def test_random_vectors_seldom_meet(spark):
    """The filters grow with the vectors: as many strangers meet for each vector at ten times the rows."""
    rng = np.random.default_rng(3)
    met = []
    for n in (4_096, 40_960):
        x = rng.standard_normal((n, 64))
        names = capfilter.ProductCode(64, *capfilter.rotations_for(64, capfilter.codewords_for(n), 0.98, 6, 4)[:1], 4, 4).decode(x / np.linalg.norm(x, axis=1, keepdims=True), 6)
        count = np.unique(names, return_counts=True)[1]
        met.append((count * (count - 1)).sum() / n)
    assert met[1] < 1.5 * met[0] and met[1] < 20


def test_contents_that_share_a_hash(spark):
    df = spark.createDataFrame([(1, 5, 70), (2, 5, 71), (3, 6, 70), (4, None, None)], "i bigint, h bigint, c bigint")
    got = {r.i: r.h for r in told_apart(df, "h", "c").collect()}
    assert got == {1: 70, 2: 71, 3: 6, 4: None}


def test_similar_groups(spark):
    """Against all pairs: groups of similarity 0.8 and more, a hot group of near copies, repeated rows and ids."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [prose(rng, rng.randrange(20, 200), words) for _ in range(40)]
    for t in list(texts):
        for share in (0.005, 0.02, 0.05):
            w = t.split()
            for k in range(len(w)):
                if rng.random() < share:
                    w[k] = rng.choice(words)
            texts.append(" ".join(w))
    hot = prose(rng, 120, words)
    texts += [hot.rsplit(" ", k % 8)[0] + f" end{k}" for k in range(150)] + ["", None, "one", texts[0]]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _n", "2 AS node")
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(links, sets)
    for limit in (4_000, 20):
        kept = simhash_groups.keep_one(df, bucket_limit=limit)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert sorted(r.doc_id or 0 for r in simhash_groups.keep_one(awkward(spark)).collect()) == [0, 1, 3, 4, 6]
    assert simhash_groups.keep_one(empty(spark)).count() == 0


def test_one_shingle_in_most_of_a_text(spark):
    """A shingle that fills over half of a text decides no match: the rest of the text differs."""
    rng = random.Random(5)
    texts = [". " * 300 + prose(rng, 60, [f"v{k}x{i}" for i in range(200)]) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_groups.keep_one(df).collect()) == list(range(12))


def test_lines_repeated_a_different_number_of_times(spark):
    """Sets alike to 0.8 and more are near copies, however often one of the texts repeats a line."""
    rng = random.Random(6)
    texts = []
    for k in range(12):
        words = [f"u{k}x{i}" for i in range(200)]
        line, rest = prose(rng, 12, words), prose(rng, 80, words)
        texts += [f"{line} {line} {rest}", f"{line} " * 300 + rest]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_groups.keep_one(df).collect()) == list(range(0, 24, 2))


def test_no_pair_at_the_threshold_is_missed(spark):
    """Short texts and the same with one more word (4 of 5 shingles), and longer ones at 12 of 15 and 80 of 100."""
    texts = []
    for k in range(600):
        more, fewer = ((9, 8), (19, 16), (104, 84))[k % 3]
        words = [f"t{k}x{i}" for i in range(more)]
        texts += [" ".join(words[:fewer]), " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash_groups.keep_one(df).collect()) == list(range(0, 1200, 2))


def test_all_pairs_of_documents(spark):
    """Every pair of similarity 0.8 and more among 1,000 documents: sets that share a shingle, compared one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders = {}, {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {b""}
        for x in sets[r.doc_id]:
            holders.setdefault(x, []).append(r.doc_id)
    pairs = {(a, b) for ids in holders.values() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    links = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = simhash_groups.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots(links, sets).values()))
    assert len(links) > 50
