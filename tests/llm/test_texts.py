import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, licenses, secrets, toxicity
from lodestone.llm.common import one_text, remainder
from tests.llm.helpers import awkward, empty, prose

WORDS = [a + b for a in "ba ce di fo gu".split() for b in "lan mer nis tok vul rad".split()]


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(2)
    index = decontaminate.Index([(i, prose(rng, rng.randrange(6, 40), WORDS)) for i in range(150)])
    for _ in range(60):
        terms = rng.sample(range(len(index.postings)), rng.randrange(1, len(index.postings)))
        scores = {}
        for t in terms:
            for d, v in zip(index.postings[t], index.impacts[t], strict=True):
                scores[d] = scores.get(d, 0) + v
        for least in (0.1, 0.4, 0.7):
            got = {d for k in range(index.bounds.shape[1]) for d, _ in index.retrieve(terms, k, least)}
            assert got == {d for d, v in scores.items() if v >= least}


def test_decontamination(spark):
    rng = random.Random(4)
    many = [f"{a}{b}" for a in WORDS for b in WORDS[:12]]
    items = [(i, prose(rng, rng.randrange(12, 60), many) + ". " + prose(rng, rng.randrange(3, 20), many) + ".") for i in range(80)]
    items += [(90, "too short"), (91, None), (92, "Question: " + prose(rng, 15, many) + "\nAnswer: " + prose(rng, 6, many))]
    docs, planted = [], set()
    for i in range(300):
        text = prose(rng, rng.randrange(0, 400), many)
        if i % 4 == 0:
            k = rng.choice([*range(80), 92])
            body = dict(items)[k]
            text = text + "\n" + body.upper() + " " + prose(rng, rng.randrange(0, 300), many)
            planted.add((i, k))
        elif i % 4 == 1:
            half = dict(items)[i % 80].split()
            text += " " + " ".join(half[: len(half) // 2])
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (16 << 20, 4_000):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, block_bytes=size).collect()}
        assert got == planted
    kept = decontaminate.decontaminate(df, bench, block_bytes=4_000)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in planted}
    assert decontaminate.decontaminate(awkward(spark), bench).count() == 9
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_license_places(spark):
    separator = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(6)
    pieces = ["MIT License", "mit-license", "Apache License,", "CC BY-NC 4.0", "cc by", "GNU General Public License, version 3", "é", "xmit license", "license", "All rights reserved.", "Licensed under the", "\n", "9"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12))) for _ in range(120)] + ["", None, "cc", "mit license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in licenses.scan(df).collect():
        w = separator.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        hits = sorted((i, label) for p, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        kept = [(d.first_word, d.end_word) for d in r.detections]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in kept for b in kept)
        assert all(0 <= a < b <= len(w) for a, b in kept)
    rows = {r.doc_id: r for r in licenses.scan(awkward(spark)).collect()}
    assert rows[1].score == 0 and rows[3].n_words == 20_000
    assert licenses.scan(empty(spark)).count() == 0


def test_license_rules(spark):
    cases = {
        "Licensed under the Apache License, Version 2.0.": {"apache", "apache-2.0"},
        "This work is licensed under CC BY-SA 4.0": {"cc-by", "cc-by-sa-4.0"},
        "SPDX-License-Identifier: MPL-2.0": {"mpl-2.0"},
        "Creative Commons Attribution-NonCommercial 3.0": {"cc-by-nc-3.0"},
        "All rights reserved.": {"all-rights-reserved"},
        "a plain text of someone's copyleft": {"copyleft"},
        "the mit building": set(),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secrets(spark):
    rng = random.Random(8)
    digits, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    draw = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    make = [lambda: draw(digits, rng.randrange(10, 44)), lambda: "AKIA" + draw("ABCDEFGHIJ234567", rng.randrange(10, 20)), lambda: "Token: token=" + draw(b64, 14), lambda: "PASSWORD = '" + draw(b64, rng.randrange(8, 20)) + "'", lambda: "api_key:" + draw(digits, 20), lambda: "\U0001f600é", lambda: prose(rng, 5, WORDS), lambda: "geheimniskraemereiundsoweiter"]
    texts = [" ".join(rng.choice(make)() for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["", None]
    secret = [draw(b64[:62], 40) for _ in range(30)]
    texts += [prose(rng, 30, WORDS) + " " + s + " end" for s in secret]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = secrets.find(df)
    more = 0
    for r in found.collect():
        text = texts[r.doc_id] or ""
        assert [(s.start, s.kind, s.end) for s in r.base_spans] == base(text)
        assert {(s.start, s.kind, s.end) for s in r.base_spans} <= {(s.start, s.kind, s.end) for s in r.spans}
        extra = [text[s.start : s.end] for s in r.spans if s.kind == 3]
        assert "geheimniskraemereiundsoweiter" not in extra
        more += any(s in extra for s in secret)
    assert more >= 27
    masked = {r.doc_id: r.text for r in secrets.redact(found).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert masked[i] is None
        else:
            assert base(masked[i]) == []
    for r in found.collect():
        text, out, at = texts[r.doc_id] or "", "", 0
        for start, _, end in r.spans:
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        assert (masked[r.doc_id] or "") == out + text[at:]
    assert secrets.find(awkward(spark)).count() == 9 and secrets.find(empty(spark)).count() == 0


def test_language_id(spark):
    rng = random.Random(10)
    sounds = {"aa": ["bla", "kro", "tu", "sch"], "bb": ["ñi", "oza", "ele", "que"], "cc": ["the", "wh", "ing", "ou"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(2, 60)))
        rows.append((i, text, lang))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, remainder(F.col("doc_id"), 4) != 2, per_language=60)
    got = langid.predict(df, model).join(df, "doc_id").filter(remainder(F.col("doc_id"), 4) == 2).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    rows = {r.doc_id: r for r in langid.predict(awkward(spark), model).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[7].lang_pred == "und" and rows[3].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.fit(empty(spark), F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(awkward(spark), None).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(12)
    bad = [f"zork{x}" for x in "abcdefghij"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 120))]
        if toxic:
            for _ in range(rng.randrange(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 3 != 1:
            labels.append((i, int(toxic != (rng.random() < 0.02))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    given = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, given, remainder(F.col("doc_id"), 5) != 0)
    scores = dict(toxicity.score(df, model).collect())
    truth = {i: i % 6 == 0 for i in scores}
    assert sum((scores[i] >= 0.5) == truth[i] for i in scores) >= 0.98 * len(scores)
    assert {r.doc_id for r in toxicity.keep_clean(df, model).collect()} == {i for i, s in scores.items() if s < 0.5}
    m = model.label_model
    assert m.correlations.shape[0] == len(m.weights) and (m.weights <= 1).all()
    rows = {r.doc_id: r.score for r in toxicity.score(awkward(spark), model).collect()}
    assert rows[1] == rows[2] and all(0 <= s < 0.5 for s in rows.values())
    assert toxicity.fit(df, given.limit(0), F.lit(True)) is None
    # nothing to learn from: no document of a labelled row, or one class only
    assert toxicity.fit(empty(spark), given, F.lit(True)) is None
    for toxic in (0, 1):
        assert toxicity.fit(df, given.filter(F.col("toxic") == toxic), F.lit(True)) is None
    assert toxicity.keep_clean(df, None).count() == df.count()
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.keep_clean(awkward(spark), model).count() == 9


@pytest.mark.parametrize("p", secrets.ENCODINGS)
def test_alphabets_have_no_repeats(p):
    assert len(set(p[1])) == len(p[1])


def test_every_language_is_learned(spark):
    """More languages than `max_languages`: the rows are divided and no language is left out."""
    rng = random.Random(8)
    rows = []
    for k in range(12):
        letters = [chr(0x4E00 + 100 * k + j) for j in range(12)]
        words = ["".join(rng.choice(letters) for _ in range(4)) for _ in range(30)]
        rows += [(len(rows) + j, prose(rng, 20, words), f"l{k:02d}") for j in range(40 if k else 200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, remainder(F.col("doc_id"), 4) != 2, per_language=30, max_languages=4, landmarks_each=2)
    assert model.languages == [f"l{k:02d}" for k in range(12)]
    assert model.landmarks.shape[1] == 12
    got = langid.predict(df, model).join(df, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_blocks_share_their_statistics(spark):
    """The same matches and scores from one index and from many, with items and documents that only partly agree."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    items = [(k, prose(rng, rng.randrange(12, 40), words)) for k in range(60)]
    items += [items[0]] * 3
    docs = []
    for k in range(60):
        w = items[k][1].split()
        w[1] = "other"
        docs.append((k, prose(rng, 30, words) + " " + " ".join(w) + " " + prose(rng, 30, words)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    given = {"retrieve": 0.6, "question": 0.4, "answer": 0.4}
    one = sorted(map(tuple, decontaminate.contaminated(d, b, **given).collect()))
    many = sorted(map(tuple, decontaminate.contaminated(d, b, block_bytes=4_000, **given).collect()))
    assert len(one) > 30 and sum(r[1] == 0 for r in one) % 4 == 0
    assert [(r[0], r[1], r[3]) for r in one] == [(r[0], r[1], r[3]) for r in many]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(one, many, strict=True))


def test_ids_in_many_rows(spark):
    """One text for each sampled id is learned from, so hot ids neither widen the sample nor depend on the rows' order."""
    rows = [(1, f"text {k} of one id", "en") for k in range(500)] + [(i, f"ein satz {i} hier", "de") for i in range(2, 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id bigint, toxic int")
    a, b = (langid.fit(x, F.lit(True)) for x in (df, df.orderBy(F.desc("text"))))
    assert (a.landmarks == b.landmarks).all() and a.landmarks.shape[1] == 17
    once = one_text(df.selectExpr("doc_id AS _k", "text AS _t"), ["_k"])
    assert once.count() == 19
    unique = once.selectExpr("_k AS doc_id", "_t AS text")
    x, y = (toxicity.fit(t, labels, F.lit(True)) for t in (df, unique))
    assert x.bias == pytest.approx(y.bias, abs=1e-9)


def written_by(pattern, rng):
    """A text that the regex matches as a whole."""

    def text(parts):
        out = []
        for op, value in parts:
            if op is re._constants.LITERAL:
                out.append(chr(value))
            elif op is re._constants.IN:
                kind, first = value[0]
                out.append("x" if kind is re._constants.CATEGORY or kind is re._constants.NEGATE else chr(first if isinstance(first, int) else first[0]))
            elif op is re._constants.MAX_REPEAT:
                low, high, inner = value
                out.append("".join(text(inner) for _ in range(rng.randint(low, min(high, low + 1)))))
            elif op is re._constants.SUBPATTERN:
                out.append(text(value[3]))
            elif op is re._constants.BRANCH:
                out.append(text(rng.choice(value[1])))
            else:
                raise ValueError(op)
        return "".join(out)

    return text(re._parser.parse(pattern)).strip()


def test_every_license_rule_passes_the_gates(spark):
    """Texts that fit only one rule are found by scan(), optional words present or not."""
    rng = random.Random(12)
    texts = [written_by(rule.pattern, rng) for rule in licenses.signatures() for _ in range(6)]
    texts += ["Distributed under BSD-3-Clause.", "the expat license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    missed = licenses.scan(df, keep=["doc_id"]).filter("size(detections) = 0").collect()
    assert [texts[r.doc_id] for r in missed] == []


def detections_of(words):
    """Rules, containment and priority written out: every match of every rule, then pairs of them."""
    text = " ".join(words)
    found = []
    for k, rule in enumerate(licenses.signatures()):
        if any(w in text for w in rule.keyword.split("|")):
            for m in re.finditer(licenses.whole_words(rule.pattern), text):
                first = text[: m.start()].count(" ")
                found.append((first, first + m[0].count(" ") + 1, k, rule.label))
    found.sort(key=lambda d: (d[0], -d[1], d[2], d[3]))
    left = [d for i, d in enumerate(found) if not any(e[0] <= d[0] and d[1] <= e[1] for e in found[:i])]
    out = []
    for d in sorted(left, key=lambda d: (d[2], d[0])):
        if not any(e[0] < d[1] and d[0] < e[1] for e in out):
            out.append(d)
    return sorted(out)


def test_priority_settles_chains(spark):
    """Taken by priority, whatever overlaps whatever: chains of two, three and more."""
    rng = random.Random(2)
    given = [[(0, -5, 3), (4, -9, 2), (8, -13, 1)], [(0, -10, 2), (3, -12, 3), (5, -14, 1)], [], [(1, -2, 0)]]
    for _ in range(200):
        starts = sorted(rng.sample(range(60), rng.randrange(1, 12)))
        ends, last = [], 0
        for a in starts:
            last = max(last + 1, a + rng.randrange(1, 14))
            ends.append(last)
        given.append([(a, -z, rng.randrange(6)) for a, z in zip(starts, ends, strict=True)])
    shape = "array<struct<first_word:bigint,minus_end:bigint,priority:int,label:string,confidence:double>>"
    df = spark.createDataFrame([(i, [(*d, "l", 1.0) for d in ds]) for i, ds in enumerate(given)], f"i int, d {shape}")
    for r in df.select("i", licenses.bound(F.col("d"), licenses._settled).alias("s")).collect():
        taken = []
        for d in sorted(given[r.i], key=lambda d: (d[2], d[0])):
            if not any(e[0] < -d[1] and d[0] < -e[1] for e in taken):
                taken.append(d)
        assert [tuple(s)[:3] for s in r.s] == sorted(taken)


def test_license_detections(spark):
    rng = random.Random(16)
    pieces = [written_by(rule.pattern, rng) for rule in rng.sample(licenses.signatures(), 150)]
    pieces += ["license", "the", "2", "0", "version", "public", "bsd", "under the", "all rights reserved", "gnu", "lesser"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(250)]
    # a better rule that overlaps in part with a worse one before it
    texts += ["open source license agreement", "commercial license agreement is licensed under the mit license", "see the license mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    separator = re.compile(licenses.SEPARATORS)
    some = 0
    for r in licenses.scan(df).collect():
        words = [w for w in separator.split(texts[r.doc_id].lower()) if w]
        wanted = detections_of(words)
        assert [(d.first_word, d.end_word, d.priority, d.label) for d in r.detections] == wanted, texts[r.doc_id]
        some += len(wanted)
    assert some > 300


def seconds(work):
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


def test_time_follows_the_matches(spark):
    """16,000 matches in one text take at most twice the time for each match that 1,000 take."""

    def took(piece, work):
        times = []
        for n in (1_000, 1_000, 16_000):
            df = spark.createDataFrame([(1, piece * n)], "doc_id bigint, text string")
            times.append(seconds(lambda df=df: work(df).write.format("noop").mode("overwrite").save()))
        return times[1], times[2]

    for piece, work in (
        ("mit license ", licenses.scan),
        ("0123456789abcdef0 x ", secrets.find),
        ("0123456789abcdef0 x ", lambda df: secrets.redact(secrets.find(df))),
    ):
        few, many = took(piece, work)
        assert many <= 2 * 16 * few


ABOVE = lambda z: math.erfc(max(-36, min(36, z)) / math.sqrt(2)) / 2


def test_normal_tail(spark):
    """Right to 1 % of itself far out, where one minus the rest would be nothing but rounding."""
    zs = [i / 8 for i in range(-96, 97)]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secrets._normal_above(F.col("z")).alias("p")).collect()
    assert all(abs(r.p / ABOVE(r.z) - 1) < 0.01 for r in got)


def battery(candidate):
    """(octave, bin, p of being random) with plain loops."""
    value = candidate.rstrip("=")
    alphabet = next(a for p, a in secrets.ENCODINGS if not p or re.search(p, value))
    n, k = len(value), len(alphabet)
    places = [alphabet.find(c) for c in value]
    chi = k / n * sum(x * x for x in Counter(c for c in value if c in alphabet).values()) - n
    uniform = ABOVE((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = [y >= k / 2 for y in places]
    ones = sum(high)
    middle = 2 * ones * (n - ones) / n + 1
    variance = (middle - 1) * (middle - 2) / (n - 1)
    changes = sum(a != b for a, b in zip(high, high[1:]))
    runs = 2 * ABOVE(abs((changes + 1 - middle) / math.sqrt(variance)) if variance > 0 else 36)
    mean = sum(places) / n
    power = sum((y - mean) ** 2 for y in places)
    lagged = sum((a - mean) * (b - mean) for a, b in zip(places, places[1:]))
    serial = 2 * ABOVE(abs(lagged / power * math.sqrt(n)) if power > 0 else 36)
    away = (n - 1) * max(0, k * secrets.TEXT_COINCIDENCE - 1)
    kinds = ["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in value]
    was, kinds = kinds, ["a" if a == "A" and b == "a" else a for a, b in zip(kinds, [*kinds[1:], ""])]
    folded = "".join(c.lower() if a != b else c for c, a, b in zip(value, was, kinds, strict=True))
    text_chi = k / n * sum(x * x for x in Counter(c for c in folded if c in alphabet).values()) - n
    text_places = [alphabet.find(c) for c in folded]
    blocks = 1 + sum(a != b for a, b in zip(kinds, kinds[1:]))
    expected = secrets.TEXT_CHANGES * (n - 1)
    steps = sum(abs(a - b) for a, b in zip(text_places, text_places[1:])) / (n - 1)
    tests = [
        ABOVE(-(text_chi - (k - 1 + away)) / math.sqrt(2 * (k - 1 + 2 * away))),
        ABOVE((blocks - 1.5 - expected) / math.sqrt(expected * (1 - secrets.TEXT_CHANGES))),
        ABOVE((steps - secrets.TEXT_STEP) / secrets.TEXT_STEP_SPREAD * math.sqrt(n - 1)),
    ]
    s = sum(-math.log(max(p, 1e-290)) for p in tests)
    bin_ = min(secrets.LAST_BIN, math.floor((s - math.log(1 + s + s * s / 2)) * secrets.BINS_PER_UNIT))
    return int(math.log2(n)), bin_, min(uniform, runs, serial)


def keys_and_words(rng):
    """(encoding, length, key) for all encodings but hex, and texts that hold them among long ordinary words."""
    alphabets = {"base32": secrets.ENCODINGS[2][1], "base36": secrets.ENCODINGS[4][1], "base62": secrets.ENCODINGS[5][1], "base64": secrets.ENCODINGS[6][1], "url": secrets.ENCODINGS[7][1]}
    keys = [(name, n, "".join(rng.choice(a) for _ in range(n))) for name, a in alphabets.items() for n in (20, 32, 40, 64, 100, 200) for _ in range(12)]
    long_words = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(7, 12))) for _ in range(120)]
    long_words += ["/".join(rng.choice(WORDS) for _ in range(8)) for _ in range(40)] + ["".join(rng.choice(WORDS).capitalize() for _ in range(7)) for _ in range(40)]
    texts = [prose(rng, 12, WORDS) + f" {key} " + rng.choice(long_words) + " " + prose(rng, 5, WORDS) for _, _, key in keys]
    return keys, texts + [prose(rng, 20, [*WORDS, *long_words]) for _ in range(60)]


def test_battery_and_false_discoveries(spark):
    """Every candidate's battery and the thresholds of Benjamini-Hochberg against plain loops; what is caught of planted keys."""
    keys, texts = keys_and_words(random.Random(21))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tested = []
    for r in df.select("doc_id", secrets.candidates(F.col("text")).alias("c")).collect():
        found = [(m.start(), m.end(), m[0]) for m in re.finditer(secrets.CANDIDATE, texts[r.doc_id])]
        assert [(c.start, c.end) for c in r.c] == [(a, z) for a, z, _ in found]
        for c, (_, _, text) in zip(r.c, found, strict=True):
            octave, bin_, p = battery(text)
            assert c.octave == octave and abs(c.bin - bin_) <= 1 and abs(c.random_p - p) <= 0.005 * p
            tested.append((c.octave, c.bin, c.random_p))
    rate, level = 0.01, 1e-4
    wanted = {}
    for octave in {o for o, _, _ in tested}:
        bins = sorted((b for o, b, p in tested if o == octave and p >= level), reverse=True)
        accepted = [b for i, b in enumerate(bins) if math.exp(-b / secrets.BINS_PER_UNIT) <= rate * sum(x >= b for x in bins) / len(bins)]
        if accepted:
            wanted[octave] = min(accepted)
    assert secrets.thresholds(df) == wanted
    caught = Counter()
    for r in secrets.find(df).collect():
        extra = {texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 3}
        if r.doc_id < len(keys):
            name, n, key = keys[r.doc_id]
            caught[name, n] += key in extra
            extra.discard(key)
        assert not extra, "an ordinary word is no secret"
    for name in ("base62", "base64", "url"):
        assert all(caught[name, n] >= 11 for n in (32, 40, 64, 100, 200)), caught
    for name in ("base32", "base36"):
        assert all(caught[name, n] >= 11 for n in (40, 64, 100, 200)), caught


def test_spans_apart(spark):
    """Random spans that a base span overlaps from any side are left out, whatever the columns are called."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        cut = sorted(rng.sample(range(60), 12))
        base_ = [(a, rng.randrange(3), z) for a, z in zip(cut[::2], cut[1::2])]
        more = [(a, 3, a + rng.randrange(1, 9)) for a in rng.sample(range(60), 5)]
        rows.append((k, sorted(base_), more))
    shape = "array<struct<start:bigint,kind:int,end:bigint>>"
    df = spark.createDataFrame(rows, f"k int, base {shape}, more {shape}")
    for r in df.select("k", secrets._apart(F.col("base"), F.col("more")).alias("s")).collect():
        _, b, more = rows[r.k]
        free = [m for m in more if not any(x[0] < m[2] and m[0] < x[2] for x in b)]
        assert [tuple(s) for s in r.s] == sorted(b + free)
    named = spark.createDataFrame([("k=1 password=abcdefghijkl1", 1, 2, 3, 4)], "text string, _base int, _more int, _row int, _all int")
    assert secrets.find(named).columns == [*named.columns, "base_spans", "spans"]
    assert secrets.redact(secrets.find(named)).first().text == "k=1 [SECRET]"


def plain_label_model(votes, start, share, rounds):
    """The same estimates with loops over rows and voters."""
    n, k = len(votes), len(votes[0])
    q = [min(0.95, max(0.05, x)) for x in start]
    for _ in range(rounds):
        rates = [[[0.5 + sum((q[i] if c else 1 - q[i]) for i in range(n) if votes[i][v] == value) for value in (-1, 0, 1)] for c in (0, 1)] for v in range(k)]
        rates = [[[x / sum(row) for x in row] for row in voter] for voter in rates]
        left = [[(votes[i][v] == 1) - q[i] * rates[v][1][2] - (1 - q[i]) * rates[v][0][2] for v in range(k)] for i in range(n)]
        size = [math.sqrt(sum(left[i][v] ** 2 for i in range(n))) + 1e-9 for v in range(k)]
        weights = []
        for v in range(k):
            total = 0.0
            for u in range(k):
                c = 1.0 if u == v else sum(left[i][v] * left[i][u] for i in range(n)) / size[v] / size[u]
                total += c if c > 0.3 else 0.0
            weights.append(1 / total)
        weights[-1] = 1.0
        z = [sum(weights[v] * math.log(rates[v][1][votes[i][v] + 1] / rates[v][0][votes[i][v] + 1]) for v in range(k) if votes[i][v] >= 0) for i in range(n)]
        low, high = -60.0, 60.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(1 / (1 + math.exp(-max(-40, min(40, x + mid)))) for x in z) / n < share else (low, mid)
        new = [1 / (1 + math.exp(-max(-40, min(40, x + (low + high) / 2)))) for x in z]
        done = max(abs(a - b) for a, b in zip(new, q)) < 1e-4
        q = new
        if done:
            break
    return q, rates, weights


def test_label_model():
    rng = np.random.default_rng(5)
    truth = rng.random(400) < 0.3
    accuracy = [0.9, 0.8, 0.75, 0.7, 0.85]
    votes = np.stack([np.where(rng.random(400) < 0.4, -1, np.where(rng.random(400) < a, truth, ~truth)) for a in accuracy], axis=1)
    votes = np.hstack([votes, votes[:, 1:2], np.where(rng.random(400) < 0.95, truth, ~truth)[:, None]]).astype(int)  # a copy of a voter, and an annotator who errs
    start = votes[:, -1].astype(float)
    model = toxicity.fit_label_model(votes, start, float(start.mean()), rounds=8)
    q, rates, weights = plain_label_model(votes.tolist(), start.tolist(), float(start.mean()), 8)
    assert np.allclose(model.posterior(votes), q, atol=1e-6)
    assert np.allclose(model.weights, weights, atol=1e-6) and np.allclose(model.rates, rates, atol=1e-6)
    assert model.weights[1] < 0.6 and model.weights[5] < 0.6, "copies share their weight"
    # estimated rates against those of the true classes, and classes better than the annotator's
    for v in range(5):
        for c in (0, 1):
            mine = np.array([(votes[truth == c, v] == value).mean() for value in (-1, 0, 1)])
            assert np.abs(model.rates[v, c] - mine).max() < 0.12
    assert ((model.posterior(votes) > 0.5) == truth).mean() >= (votes[:, -1] == truth).mean()


def test_language_scores_against_a_direct_computation(spark):
    """Kernels from sets of hashed n-grams, one by one, and the ridge regressions solved in kernel form."""
    rng = random.Random(4)
    sounds = {"aa": ["bla", "kro", "tu"], "bb": ["ñi", "oza", "ele"], "cc": ["the", "wh", "ing"]}
    texts, langs = [], []
    for i in range(36):
        lang = sorted(sounds)[i % 3]
        texts.append(" ".join("".join(rng.choice(sounds[lang]) for _ in range(2)) for _ in range(rng.randrange(1, 8))))
        langs.append(lang)

    def grams(text):
        out, start = [], 0
        points = [ord(c) for c in text.lower()]
        for n, size in langid.TABLES.items():
            here = set()
            for k in range(len(points) - n + 1):
                value = 0
                for p in points[k : k + n]:
                    value = (value * 0x100000001B3 + p) % (1 << 64)
                mixed = (value ^ (value >> 29)) * 0x9E3779B97F4A7C15 % (1 << 64)
                here.add(start + (mixed >> (64 - size.bit_length() + 1)))
            out.append(here)
            start += size
        return out

    every = [grams(t) for t in texts]
    assert all(set(np.flatnonzero(row)) == set().union(*g) for row, g in zip(langid.presence(texts), every, strict=True))
    kernel = lambda a, b: sum(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(a, b, strict=True)) / 3
    each, ridge = 4, 1e-3
    model = langid.train(np.packbits(langid.presence(texts), axis=1), langs, each, ridge, slice_rows=7)
    chosen = [i for lang in sorted(sounds) for i in [j for j in range(36) if langs[j] == lang][:each]]
    among = np.array([[kernel(every[i], every[j]) for j in chosen] for i in chosen])
    to = np.array([[kernel(g, every[j]) for j in chosen] for g in every])
    values, vectors = np.linalg.eigh(among)
    x = to @ (vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()]))
    x1 = np.hstack([x, np.ones((36, 1))])
    for k, lang in enumerate(sorted(sounds)):
        y = np.where(np.array(langs) == lang, 1.0, -1.0)
        w = np.linalg.solve(x1.T @ x1 / 12 + ridge * np.eye(x1.shape[1]), x1.T @ y / 12)
        assert np.abs(model.scores(langid.presence(texts))[:, k] - x1 @ w).max() < 1e-2
    signs = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2160 \u2461 12_3"), (3, "\u00aa"), (4, "12 x")], "doc_id bigint, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(signs, model).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und" and got[4] != "und"


def test_short_items_and_many_indexes(spark, monkeypatch):
    """Items of one to four words are found where they stand in a row; several passes give what one gives."""
    items = [(1, "zebra quick fox"), (2, "unique"), (3, "a b c d"), (4, "one two three four five six. Answer: seven eight"), (5, ""), (6, None)]
    texts = ["the Zebra, quick fox ran", "zebra fox quick", "so unique!", "x a b c d y", "a b x c d", "one two three four five six. answer: seven eight", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wanted = {(0, 1), (2, 2), (3, 3), (5, 4)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == wanted
    monkeypatch.setattr(decontaminate, "INDEXES", 2)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, block_bytes=20).collect()} == wanted
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench, block_bytes=20).collect()} == {1, 4, 6, 7}
