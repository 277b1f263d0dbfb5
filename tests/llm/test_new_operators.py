"""Filter overlaps, vector codes and repeated passages against brute force."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filteraudit, queries, suffixdedup, vectorcodes
from tests.llm.helpers import awkward, prose
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_vector_codes"])
def test_sql(spark, sf_dir, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, sf_dir))
    wanted_columns, wanted = sql_rows(sf_dir, queries.ORACLE_SQL[name])
    assert columns == wanted_columns and rows == wanted


def fails(text, ids, doc_id):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    bad = {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and any(i is not None and i < doc_id for i in ids),
    }
    return {k for k, v in bad.items() if v}


def audited(docs, labels):
    """Every order applied document by document."""
    same, rows = {}, []
    for doc_id, text, _ in docs:
        same.setdefault(text or "", []).append(doc_id)
    good, toxic = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    for part in sorted({lang or "" for *_, lang in docs}):
        given = [(d, fails(t or "", same[t or ""], d)) for d, t, lang in docs if (lang or "") == part]
        out = []
        for order in permutations("ABCDE"):
            alive = given
            for step, f in enumerate(order, 1):
                gone, kept = [x for x in alive if f in x[1]], [x for x in alive if f not in x[1]]
                failing = [x for x in given if f in x[1]]
                out.append((f, ["".join(order), step, len(kept), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in given), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]))
                alive = kept
        total = {f: sum(r[3] for g, r in out if g == f) for f in "ABCDE"}
        rows += [tuple([part, *r, total[f]]) for f, r in out]
    return sorted(rows)


def test_audit_of_awkward_documents(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in awkward(spark).collect()]
    docs += [(i, ("A# " if i % 3 else "b ") * (i * 40), "en" if i % 2 else None) for i in range(20, 32)] + [(i, "A# " * 40, "x") for i in range(40, 45)] + [(None, "A# " * 40, "x")]
    labels = [(4, 1, 0), (4, 0, 1), (21, 1, 1), (22, None, 1), (None, 1, 1), (40, 1, None), (41, 0, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS part", "2 AS mask", "'x' AS _t", "3 AS n")
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("mask", F.lit(1))
    got = filteraudit.audit(df, given)
    assert sorted(tuple(r) for r in got.collect()) == audited(docs, labels)
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert filteraudit.audit(df.limit(0), given).count() == 0
    assert filteraudit.audit(df, given.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_gray_code_walk():
    counts = np.random.default_rng(1).integers(0, 9, (3, 4, 32))
    states = filteraudit.survivors(counts)
    for s in range(32):
        assert (states[s] == counts[..., [m for m in range(32) if not m & s]].sum(axis=-1)).all()


def coded(rows, parts, entries, rounds=2):
    """Plain k-means over integer parts; rows of (id, vector, label), sorted."""
    x = np.array([[np.floor(256 * np.float64(v)) for v in r[1]] for r in rows], dtype=np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[at[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    at, d = assign()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    error = d.sum(axis=1)
    by_label = {lab: int(sum(e for e, r in zip(error, rows, strict=True) if r[2] == lab)) for lab in {r[2] for r in rows}}
    return sorted((r[0], "".join(f"{c:02x}" for c in a), int(e), by_label[r[2]], digest) for r, a, e in zip(rows, at, error, strict=True))


@pytest.mark.parametrize("n,dimension,spread", [(700, 64, 1.0), (300, 32, 0.02), (40, 16, 3000.0)])
def test_vector_codes(spark, n, dimension, spread):
    """Against plain rounds: ties and repeated vectors, fewer vectors than entries, rows that are left out."""
    rng = np.random.default_rng(n)
    x = (rng.standard_normal((n, dimension)) * spread).astype(np.float32)
    x[n // 2 : n // 2 + 5] = x[0]
    rows = [(i * 3, x[i].tolist(), None if i % 7 == 0 else i % 3) for i in range(n)]
    bad = [(-1, None, 1), (-2, [None] + [1.0] * (dimension - 1), 1), (-3, [float("nan")] * dimension, 1), (-4, [float("inf")] * dimension, 2), (9999, [1.0] * (dimension + 16), 1), (9998, [1.0] * 3, 1), (9997, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS code", "'p' AS parts", "2 AS _id", "3 AS error")
    got = vectorcodes.compress(df.repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == coded(rows, 16, 64)
    assert vectorcodes.compress(df.limit(0)).count() == 0
    assert vectorcodes.compress(df.filter("vec_id < 0")).count() == 0


def test_bounds_spare_distances():
    """Bounds of several rounds give the entries of full scans, with fewer distances; the net way is the tighter one."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 64)) * 40
    x = np.floor(centres[rng.integers(0, 60, 3000)] + rng.standard_normal((3000, 64))).astype(np.int64).reshape(-1, 16, 4)
    history = [x[:64].transpose(1, 0, 2).copy()]
    known, _ = vectorcodes.first_scan(x, history[0])
    spared = []
    for _ in range(5):
        at = known.entry
        sums = {(p, e): (int((at[:, p] == e).sum()), x[at[:, p] == e, p].sum(axis=0).tolist()) for p in range(16) for e in range(64) if (at[:, p] == e).any()}
        history.append(vectorcodes._averaged(history[-1], sums))
        known, best, measured = vectorcodes.next_scan(x, known, history)
        full, least = vectorcodes.first_scan(x, history[-1])
        assert (known.entry == full.entry).all() and (best == least).all()
        spared.append(measured / (x.shape[0] * 16 * 64))
    assert spared[-1] < 0.6
    net = vectorcodes.net_displacements(history)
    steps = sum(vectorcodes.net_displacements(history[i : i + 2])[0] for i in range(5))
    assert (net[0] <= steps + 1e-6).all() and (net[0] < steps - 1e-6).any()


def deduped(rows, length=100):
    """Every window of every text in order."""
    tie = lambda r: (r[0] is None, r[0] or 0, r[2])
    seen, out = {}, []
    for doc_id, text, t in sorted(rows, key=tie):
        data = text.encode()
        mark = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if seen.setdefault(w, (doc_id, t, i)) != (doc_id, t, i):
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(data, mark, strict=True) if not m)
        spans = len(re.findall(b"\1+", bytes(mark)))
        out.append((doc_id, len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def with_ties(df):
    return [(r.doc_id, r.text, r.t) for r in df.selectExpr("doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) & 2147483647 AS t").collect()]


def checked(df, **given):
    got = suffixdedup.dedup(df, **given)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == deduped(with_ties(df), given.get("length", 100))


@pytest.mark.parametrize("hot_limit", [3, 2_000])
def test_repeats_of_documents(spark, sf_dir, hot_limit):
    """All documents of the test table against all windows."""
    checked(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7), hot_limit=hot_limit)


@pytest.mark.parametrize("hot_limit", [2, 2_000])
def test_repeats_of_planted_passages(spark, hot_limit):
    """Passages of many lengths around 100 bytes, in the same and other documents, at edges, and periodic texts."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu"]
    shared = [prose(rng, n, words)[:size] for n, size in [(40, 99), (40, 100), (40, 101), (60, 150), (60, 220), (200, 900)]]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 30), words)]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), prose(rng, rng.randrange(0, 12), words)]
        rows.append((rng.randrange(0, 60) if i % 9 else None, "".join(parts)))
    rows += [(70, "ab" * 500), (71, "ab" * 300 + "c" + "ab" * 60), (72, "x" * 100), (73, "x" * 99), (74, "x" * 5000), (75, ""), (76, None), (77, shared[5]), (77, shared[5]), (78, shared[5][1:])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS h", "2 AS doc", "'x' AS tie", "3 AS span", "4 AS runs")
    checked(df.repartition(6), hot_limit=hot_limit)
    checked(df.repartition(3), hot_limit=hot_limit, length=20, gram=7)


def test_repeats_of_awkward_documents(spark):
    checked(awkward(spark))
    assert suffixdedup.dedup(awkward(spark).limit(0)).count() == 0


def test_long_documents_are_read_in_pieces(spark, monkeypatch):
    """Anchors of pieces are those of the whole text."""
    rng = random.Random(6)
    text = prose(rng, 3000, ["one", "two", "three", "four", "five", "six", "seven"]).encode()
    offsets = np.array([0, len(text)])
    whole = next(suffixdedup.pieces(offsets, 100, 32, 1 << 20))
    covered = {}
    for most in (1 << 20, 2_000):
        found = set()
        for group in suffixdedup.pieces(offsets, 100, 32, most):
            for _, start, end, low, high in group:
                data = np.frombuffer(text[start:end], dtype=np.uint8)
                one = lambda v: np.array([v])
                _, h, f, place, first, last = suffixdedup.anchors(data, one(0), one(end - start), one(low - start), one(high - start), 100, 32)
                for k in range(len(h)):
                    found |= {(int(h[k]), int(f[k]), int(place[k]) + start, w + start) for w in range(first[k], last[k] + 1)}
        covered[most] = found
    assert len(whole) == 1 and covered[1 << 20] == covered[2_000]


def test_suffix_sort_and_collisions():
    """The order of the texts, also where every hash is the same and bytes must decide."""
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    group = np.sort(np.array([rng.randrange(0, 25) for _ in texts]))
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    counts = np.diff(np.append(starts, len(group)))
    begin, end = np.repeat(starts, counts), np.repeat(starts + counts, counts)
    broken = suffixdedup.Hashes(3)
    broken.values = np.zeros(256, dtype=np.uint64)
    for hashes in (suffixdedup.Hashes(3), broken):
        s = suffixdedup.Suffixes(data, np.cumsum(size) - size, size, hashes)
        order, shared = s.verified(s.order(begin, end), group)
        assert [texts[i] for i in order] == [t for _, t in sorted(zip(group.tolist(), texts, strict=True))]
        for i in range(1, len(order)):
            a, b = texts[order[i - 1]], texts[order[i]]
            same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert shared[i] == (same if group[i] == group[i - 1] else -1)
