"""Secret scans: fixed patterns and a randomness test battery, in DataFrame operations only.

Base kinds are found by their patterns. Besides them, every run of 20 or more
characters of the base64 alphabets is a candidate. Its encoding is inferred (hex,
base32, base36, base62, base64), and two questions are put to it.

Is it consistent with random characters of that encoding? Three tests: chi-squared
uniformity over the encoding's alphabet, a runs test of characters above and below
the alphabet's middle, and the lag-one serial correlation of their places in it. A
candidate that any of the three rejects at `random_level` is no secret.

Could it be ordinary text? The same three, against what text is like: chi-squared
uniformity against letters of a language (a noncentral distribution that moves away with
the length), runs of lower case, upper case, digits and signs, which ordinary words
hardly have, and how far neighbours lie apart in the alphabet; a capital that begins a word counts as a small
letter in all of them. The three are combined by
Fisher's method into a p-value. Long candidates give far smaller p-values than short
ones, so false discoveries are controlled by Benjamini-Hochberg within each octave of
lengths, over the candidates of all documents that the first question leaves: a first
pass counts p-values in bins, a second applies the thresholds.

A random span is left out where a base span overlaps it, so base spans always stay.
Spans are (kind, start, end) in code points, the end exclusive.

Defined results: a null text is the empty text and has no spans; each row gives one
row, repeated rows included; all columns of the input but those named like an output
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound, highest_before, sums_before, text_or_empty

#: The base kinds in order, what gates each, its pattern and the least length of its secret.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
SPAN = "array<struct<start:bigint,end:bigint,kind:int,text:string>>"

#: encoding: (what the whole candidate must match, its alphabet)
ENCODINGS = [
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("^[A-Z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
#: Running text: sum of squared letter shares, share of neighbours of different classes, and how many letters
#: of the alphabet lie between neighbours, with its deviation.
TEXT_COINCIDENCE, TEXT_CHANGES, TEXT_STEP, TEXT_STEP_SPREAD = 0.068, 0.06, 7.9, 5.7
BINS_PER_UNIT, LAST_BIN = 20, 4000


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches as (start, end, kind, text)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    paired = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda h, g: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("size"), h.alias("text")))

    def placed(pairs: Column) -> Column:
        def one(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["text"].alias("text"))

        return F.zip_with(pairs, sums_before(F.transform(pairs, lambda x: x["gap"] + x["size"])), one)

    return bound(paired, placed)


def _where(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Array of base spans, by start and then kind. Hex runs of `HEX_LEAST` and access keys match as long as they are anyway."""
    gate = text.rlike("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]")
    secret = lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LEAST
    assign = F.filter(_matches(text, ASSIGN, 0), secret)
    access = F.filter(_matches(text, ACCESS, 1), lambda s: F.char_length(s["text"]) >= ACCESS_LEAST)
    runs = _matches(text, f"[0-9a-f]{{{HEX_LEAST},}}", 2)
    return F.concat(
        _where(gate, assign), _where(text.contains("AKIA"), access), _where(text.rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), runs)
    )


def _normal_above(z: Column) -> Column:
    """The normal distribution's upper tail, within 0.3 % of itself however far out."""

    def tail(x: Column) -> Column:
        return F.exp(-x * x / 2) / 2.5066282746310002 / (0.661 * x + 0.339 * F.sqrt(x * x + 5.51))

    z = F.greatest(F.least(z, F.lit(36.0)), F.lit(-36.0))
    return F.when(z >= 0, tail(z)).otherwise(1 - tail(-z))


def _tested(span: Column) -> Column:
    """A candidate span with its length octave, the p-value of ordinary text and whether it may be random."""
    value = F.rtrim(span["text"], F.lit("="))
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(value.rlike(pattern), letters).otherwise(alphabet)
    n = F.char_length(value).cast("double")
    k = F.char_length(alphabet).cast("double")
    classes = lambda v: F.translate(
        v,
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "A" * 26 + "a" * 26 + "0" * 10,
    )
    # for the question after text, a capital that begins a word is a small letter
    kinds = F.split(classes(value), "")
    begins = lambda i: (F.get(kinds, i) == "A") & F.coalesce(F.get(kinds, i + 1) == "a", F.lit(False))
    folded = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(begins(i), F.lower(c)).otherwise(c)), "")
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def chi(v: Column) -> Column:
        counts = F.transform(F.split(alphabet, ""), lambda c: n - F.char_length(F.replace(v, c, F.lit(""))))
        return k / n * add(counts, lambda c: c * c) - n

    # places 0 .. k-1 of the characters in the alphabet
    places = lambda v: F.transform(F.split(v, ""), lambda c: (F.position(c, alphabet) - 1).cast("double"))
    parts = lambda f: F.struct(
        n.alias("n"), k.alias("k"), chi(value).alias("chi2"), places(value).alias("x"),
        F.char_length(F.regexp_replace(classes(f), "(.)\\1*", "-")).cast("double").alias("blocks"),
        chi(f).alias("text_chi2"), places(f).alias("text_x"),
    )
    s = bound(folded, parts)
    # bind the parts once, then test
    return F.transform(F.array(s), lambda v: _judged(span, v))[0]


def _judged(span: Column, v: Column) -> Column:
    n, k, chi2, x = v["n"], v["k"], v["chi2"], v["x"]
    add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, y: a + f(y))
    spread = F.sqrt(2 * (k - 1) * (n - 1) / n)
    uniform = _normal_above((chi2 - (k - 1)) / spread)

    high = F.transform(x, lambda y: F.when(y >= k / 2, 1.0).otherwise(0.0))
    later = lambda xs: F.slice(xs, F.lit(2), F.size(xs))
    changes = add(F.zip_with(high, later(high), lambda a, b: F.coalesce(F.abs(a - b), F.lit(0.0))), lambda y: y)
    ones = add(high, lambda y: y)
    zeros = n - ones
    middle = 2 * ones * zeros / n + 1
    variance = (middle - 1) * (middle - 2) / (n - 1)
    runs_z = F.when(variance > 0, (changes + 1 - middle) / F.sqrt(variance)).otherwise(F.lit(36.0))
    runs = 2 * _normal_above(F.abs(runs_z))

    mean = add(x, lambda y: y) / n
    power = add(x, lambda y: (y - mean) * (y - mean))
    lagged = F.zip_with(x, later(x), lambda a, b: F.coalesce((a - mean) * (b - mean), F.lit(0.0)))
    serial_z = F.when(power > 0, add(lagged, lambda y: y) / power * F.sqrt(n)).otherwise(F.lit(36.0))
    serial = 2 * _normal_above(F.abs(serial_z))

    away = (n - 1) * F.greatest(F.lit(0.0), k * TEXT_COINCIDENCE - 1)
    text_chi = _normal_above(-(v["text_chi2"] - (k - 1 + away)) / F.sqrt(2 * (k - 1 + 2 * away)))
    expected = TEXT_CHANGES * (n - 1)
    text_changes = _normal_above((v["blocks"] - 1 - 0.5 - expected) / F.sqrt(expected * (1 - TEXT_CHANGES)))
    steps = add(F.zip_with(v["text_x"], later(v["text_x"]), lambda a, b: F.coalesce(F.abs(a - b), F.lit(0.0))), lambda y: y) / (n - 1)
    text_steps = _normal_above((steps - TEXT_STEP) / TEXT_STEP_SPREAD * F.sqrt(n - 1))
    tiny = F.lit(1e-290)
    statistic = -F.log(F.greatest(text_chi, tiny)) - F.log(F.greatest(text_changes, tiny)) - F.log(F.greatest(text_steps, tiny))
    minus_log = statistic - F.log(1 + statistic + statistic * statistic / 2)  # Fisher's method for three p-values
    return F.struct(
        span["start"].alias("start"),
        span["end"].alias("end"),
        F.floor(F.log2(n)).cast("int").alias("octave"),
        F.least(F.floor(minus_log * BINS_PER_UNIT), F.lit(LAST_BIN)).cast("int").alias("bin"),
        F.least(uniform, runs, serial).alias("random_p"),
    )


def candidates(text: Column) -> Column:
    """Array of (start, end, octave, bin, random_p) of all candidate spans."""
    spans = _where(text.rlike(CANDIDATE), _matches(text, CANDIDATE, 3))
    return F.transform(spans, _tested)


def thresholds(df: DataFrame, text: str = "text", rate: float = 0.01, random_level: float = 1e-4) -> dict[int, int]:
    """octave -> the least bin of -log p that Benjamini-Hochberg accepts at `rate` among its candidates that may be random.

    The counts of all documents' candidates come to the driver by octave and bin, at
    most 4,001 bins for each of some 30 octaves, whatever the size of the input.
    """
    found = df.select(F.explode(candidates(text_or_empty(text))).alias("c")).filter(F.col("c.random_p") >= random_level)
    counts = found.groupBy("c.octave", "c.bin").agg(F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    for octave in {r.octave for r in counts}:
        own = sorted((r for r in counts if r.octave == octave), key=lambda r: -r.bin)
        total, seen = sum(r.n for r in own), 0
        for r in own:
            seen += r.n
            if 2.718281828459045 ** (-r.bin / BINS_PER_UNIT) <= rate * seen / total:
                out[octave] = r.bin
    return out


def _apart(base: Column, added: Column) -> Column:
    """`base` and those of `added` (start, kind, end) that overlap none of it, by start and then kind.

    All are put in order of their starts; a span is free if no base span before it ends
    beyond its start and the next base span does not start before its end.
    """

    def choose(every: Column) -> Column:
        own = lambda s, value, other: F.when(s["kind"] < len(KINDS) - 1, value).otherwise(other)
        ends = highest_before(F.transform(every, lambda s: own(s, s["end"], F.lit(0))))
        # the least start after each, as the highest of the negative ones, from the back
        far = 1 << 60
        starts = F.reverse(highest_before(F.transform(F.reverse(every), lambda s: own(s, far - s["start"], F.lit(0)))))
        marked = F.zip_with(F.zip_with(every, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), starts, lambda x, n: F.struct(x["s"].alias("s"), x["e"].alias("e"), (far - n).alias("n")))
        kept = F.filter(marked, lambda x: own(x["s"], F.lit(True), (x["e"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"])))
        return F.transform(kept, lambda x: x["s"])

    return F.when(F.size(added) == 0, base).otherwise(bound(F.array_sort(F.concat(base, added)), choose))


def find(
    df: DataFrame, text: str = "text", rate: float = 0.01, random_level: float = 1e-4, base: str = "base_spans", spans: str = "spans"
) -> DataFrame:
    """`df` with the arrays `base` and `spans` of (start, kind, end), all spans sorted by start and then kind."""
    accepted = thresholds(df, text, rate, random_level)
    by_octave = F.create_map(*(F.lit(x) for pair in accepted.items() for x in pair)) if accepted else None
    short = lambda xs: F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    value = F.coalesce(F.col(f"_row.`{text}`"), F.lit(""))
    # the row is one column from here on, so its columns may have any names
    out = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    out = out.withColumn("_base", F.array_sort(short(base_spans(value))))
    if by_octave is None:
        out = out.withColumn("_all", F.col("_base"))
    else:
        good = lambda c: (c["random_p"] >= random_level) & (c["bin"] >= F.coalesce(F.try_element_at(by_octave, c["octave"]), F.lit(LAST_BIN + 1)))
        added = F.transform(F.filter(candidates(value), good), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
        out = out.withColumn("_more", added).withColumn("_all", _apart(F.col("_base"), F.col("_more")))
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c not in (base, spans)]
    return out.select(*kept, F.col("_base").alias(base), F.col("_all").alias(spans))


def named(spans: Column) -> Column:
    """`kind:start:end` of all spans, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mask: str = "[SECRET]", piece: int = 1024) -> DataFrame:
    """`df` with every span of `text` replaced by `mask`; spans that overlap become one.

    The text is cut once into pieces of `piece` characters, so that what stands between
    two spans is taken from the pieces at hand and not counted off from the text's start.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def between(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / piece).cast("int")
        near = F.array_join(F.slice(cut, first + 1, F.floor(end / piece).cast("int") - first + 1), "")
        return F.substring(near, (start % piece + 1).cast("int"), (end - start).cast("int"))

    def masked(cut: Column) -> Column:
        def one(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(between(cut, at, s["start"]), F.lit(mask))).otherwise("")

        parts = F.zip_with(F.col(spans), highest_before(F.transform(F.col(spans), lambda s: s["end"])), one)
        rest = between(cut, F.array_max(F.transform(F.col(spans), lambda s: s["end"])), F.char_length(text).cast("bigint"))
        return F.concat(F.array_join(parts, ""), rest)

    return df.withColumn(text, F.when(F.size(spans) > 0, bound(pieces, masked)).otherwise(F.col(text)))
