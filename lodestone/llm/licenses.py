"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame operations only.

A text becomes its words joined by single spaces. A document that holds none of the
`KEYWORDS` goes no further. Otherwise each rule whose own keyword occurs is searched,
and every place it matches is a detection (first word, end word, label, priority,
confidence). Overlaps are resolved by interval containment and priority: of detections
ordered by start, longer first, then by priority, one that lies within another is
suppressed; of neighbours that are left and overlap in part, the one of better priority
stays. The four base phrases are counted apart from that, so all their places count and
their labels always stay.

Defined results: a null text is the empty text with no words; a document without a
detection has no labels ('' and score 0); each row gives one row, repeated rows
included.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, bound, highest_before, sums_before, text_or_empty

#: What separates words, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: A text without any of these has no detection; each rule needs one of them besides its own keyword.
KEYWORDS = ["licen", "copyright", "rights reserved", "public domain", "creative commons", "cc by", "cc0", "spdx", "copyleft", "proprietary", "all wrongs", "rights are reserved", "bsd 2 clause", "bsd 3 clause", "permission", "redistribution"]


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    pattern: str
    confidence: float


#: label, keyword, how a text names it (a regex over words), versions (regex, suffix of the label).
_FAMILIES = [
    ("apache", "apache", "apache(?: software)? licen[cs]e", [("2 0", "2.0"), ("1 1", "1.1"), ("1 0", "1.0")]),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", [("3", "3.0"), ("1", "1.0")]),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", [("3", "3.0"), ("2 1", "2.1"), ("2", "2.0")]),
    ("lgpl", "library", "gnu library general public licen[cs]e", [("2", "2.0")]),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", [("1 3", "1.3"), ("1 2", "1.2"), ("1 1", "1.1")]),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e", [("3", "3.0"), ("2", "2.0"), ("1", "1.0")]),
    ("mit", "mit|expat|x11", "(?:the )?(?:mit|expat|x11) licen[cs]e", []),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd(?: style)? licen[cs]e", []),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: licen[cs]e)?", []),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: licen[cs]e)?", []),
    ("bsd-2-clause", "2 clause", "2 clause bsd licen[cs]e", []),
    ("bsd-3-clause", "3 clause", "3 clause bsd licen[cs]e", []),
    ("isc", "isc", "isc licen[cs]e", []),
    ("mpl", "mozilla", "mozilla public licen[cs]e", [("2 0", "2.0"), ("1 1", "1.1"), ("1 0", "1.0")]),
    ("epl", "eclipse", "eclipse public licen[cs]e", [("2 0", "2.0"), ("1 0", "1.0")]),
    ("cddl", "cddl|common development", "common development and distribution licen[cs]e", [("1 1", "1.1"), ("1 0", "1.0")]),
    ("cpl", "common public", "common public licen[cs]e", [("1 0", "1.0")]),
    ("eupl", "european union", "european union public licen[cs]e", [("1 2", "1.2"), ("1 1", "1.1")]),
    ("artistic", "artistic", "artistic licen[cs]e", [("2 0", "2.0"), ("1 0", "1.0")]),
    ("boost", "boost", "boost software licen[cs]e", [("1 0", "1.0")]),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", []),
    ("unlicense", "unlicense", "(?:the )?unlicense", []),
    ("wtfpl", "what the", "do what the \\S+ you want to public licen[cs]e", []),
    ("python", "python", "python(?: software foundation)? licen[cs]e", [("2 0", "2.0")]),
    ("php", "php", "php licen[cs]e", [("3 01", "3.01"), ("3 0", "3.0")]),
    ("postgresql", "postgresql", "postgresql licen[cs]e", []),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e", [("1 1", "1.1"), ("1 0", "1.0")]),
    ("odbl", "open data", "open (?:data commons open )?database licen[cs]e", [("1 0", "1.0")]),
    ("odc-by", "open data", "open data commons attribution licen[cs]e", [("1 0", "1.0")]),
    ("ogl", "open government", "open government licen[cs]e", [("3 0", "3.0"), ("2 0", "2.0"), ("1 0", "1.0")]),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", []),
    ("bsl", "business source", "business source licen[cs]e", [("1 1", "1.1")]),
    ("sspl", "server side", "server side public licen[cs]e", [("1", "1.0")]),
    ("elastic", "elastic", "elastic licen[cs]e", [("2 0", "2.0")]),
    ("openrail", "openrail|responsible ai", "(?:open responsible ai|openrail(?: m)?) licen[cs]e", []),
    ("cc0", "cc0|creative commons zero", "(?:cc0|creative commons zero)(?: licen[cs]e)?", [("1 0", "1.0")]),
]

_CC_KINDS = [
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:s|atives|ative works)"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
]
_CC_VERSIONS = ["4 0", "3 0", "2 5", "2 0", "1 0"]

#: What stands before a name when a licence is granted and not just mentioned.
_GRANT = "(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|made available)(?: to you)?(?: only)? under(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)?(?: following)?"

_PLAIN = [
    ("all-rights-reserved", "rights reserved|rights are reserved", "all rights (?:are )?reserved", 0.9),
    ("some-rights-reserved", "rights reserved", "some rights reserved", 0.8),
    ("no-rights-reserved", "rights reserved", "no rights reserved", 0.8),
    ("copyright", "copyright", "copyright (?:c )?(?:[12][0-9]{3})(?: [12][0-9]{3})*", 0.7),
    ("copyright", "copyright", "(?:protected|covered) by copyright", 0.6),
    ("proprietary", "proprietary", "proprietary(?: and confidential| software| information)", 0.8),
    ("proprietary", "licen", "(?:end user|commercial) licen[cs]e agreement", 0.8),
    ("proprietary", "licen", "not (?:be )?(?:copied|reproduced|redistributed|distributed)(?: \\S+){0,6} licen[cs]e", 0.7),
    ("public-domain", "public domain", "(?:in|into|to) the public domain", 0.9),
    ("public-domain", "public domain", "public domain (?:dedication|mark|work)", 0.9),
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 1.0),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("gpl", "licen", "either version [123] of the licen[cs]e or (?:at your option )?any later version", 0.9),
    ("copyleft", "copyleft", "copyleft", 0.5),
    ("generic", "licen", "(?:see|refer to)(?: the)? licen[cs]e(?: file)?", 0.4),
    ("generic", "licen", "open source licen[cs]e", 0.4),
    ("generic", "licen", "free software licen[cs]e", 0.4),
]


def signatures() -> list[Signature]:
    """The rules in order of priority: grants before named versions before names before hints."""
    grants, versions, names, tags = [], [], [], []
    for label, keyword, name, numbers in _FAMILIES:
        for number, suffix in numbers:
            full = f"{name}(?: (?:version |v ?)?{number})"
            grants.append(Signature(f"{label}-{suffix}", keyword, f"{_GRANT} {full}", 1.0))
            versions.append(Signature(f"{label}-{suffix}", keyword, full, 0.8))
            tags.append(Signature(f"{label}-{suffix}", "spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ')} {number}(?: 0)?(?: only| or later)?", 1.0))
        grants.append(Signature(label, keyword, f"{_GRANT} {name}", 0.9))
        names.append(Signature(label, keyword, name, 0.6))
        tags.append(Signature(label, "spdx", f"spdx licen[cs]e identifier {label.replace('-', ' ')}", 0.9))
    for label, short, long in _CC_KINDS:
        for number in _CC_VERSIONS:
            for form, keyword in ((f"(?:creative commons|cc) {short}", "cc|creative commons"), (f"creative commons {long}", "creative commons")):
                full = f"{form}(?: (?:international|unported|generic))?(?: licen[cs]e)?(?: version)? {number}"
                grants.append(Signature(f"{label}-{number.replace(' ', '.')}", keyword, f"{_GRANT} {full}", 1.0))
                versions.append(Signature(f"{label}-{number.replace(' ', '.')}", keyword, full, 0.8))
        names.append(Signature(label, "cc|creative commons", f"(?:creative commons|cc) {short}", 0.6))
        names.append(Signature(label, "creative commons", f"creative commons {long}", 0.6))
    plain = [Signature(*row) for row in _PLAIN]
    return [*grants, *tags, *versions, *names, *plain]


def _words_in(column: Column) -> Column:
    """Words of a text that starts and ends without a space."""
    spaces = F.char_length(column) - F.char_length(F.replace(column, F.lit(" "), F.lit("")))
    return F.when(column == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def _spaces_in(column: Column) -> Column:
    return (F.char_length(column) - F.char_length(F.replace(column, F.lit(" "), F.lit("")))).cast("long")


def _outer(found: Column) -> Column:
    """Detections in order, without those that lie within one before them: none of those ends later."""
    with_end = F.zip_with(found, highest_before(F.transform(found, lambda d: -d["minus_end"])), lambda d, e: F.struct(d.alias("d"), e.alias("e")))
    return F.transform(F.filter(with_end, lambda x: -x["d"]["minus_end"] > x["e"]), lambda x: x["d"])


def _settled(found: Column) -> Column:
    """Detections taken by priority, best first and earlier ones first, each unless it overlaps one that is taken.

    None lies within another here, so starts and ends both rise, and only detections of one
    chain of overlaps decide on each other: chains are settled one by one.
    """
    overlap = lambda d, e: (e["first_word"] < -d["minus_end"]) & (d["first_word"] < -e["minus_end"])

    def taken(chain: Column) -> Column:
        ranked = F.array_sort(F.transform(chain, lambda d: F.struct(d["priority"].alias("priority"), d["first_word"].alias("first_word"), d["minus_end"].alias("minus_end"), d.alias("d"))))
        nothing = F.filter(ranked, lambda d: F.lit(False))
        best = F.aggregate(ranked, nothing, lambda got, d: F.when(F.exists(got, lambda e: overlap(d, e)), got).otherwise(F.concat(got, F.array(d))))
        return F.transform(best, lambda d: d["d"])

    def chains(begins: Column) -> Column:
        ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(found)))
        return F.zip_with(begins, ends, lambda a, z: bound(F.slice(found, a + 1, z - a), lambda c: F.when(F.size(c) > 1, bound(c, taken)).otherwise(c)))

    # a chain begins where the one before has ended; the ends rise, so the last end is the highest
    at = F.transform(found, lambda d, i: F.when((i == 0) | (d["first_word"] >= -F.try_element_at(found, i)["minus_end"]), i))
    begins = F.filter(at, lambda i: i.isNotNull())
    return F.when(F.size(found) > 1, F.array_sort(F.flatten(bound(begins, chains)))).otherwise(found)


def whole_words(pattern: str) -> str:
    return f"(?<![^ ])(?:{pattern})(?![^ ])"


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` and n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    `detections` is an array of (first_word, end_word, label, priority, confidence) that
    were not suppressed, words counted from 0 and the end exclusive.
    """
    keep = keep if keep is not None else ["doc_id"]
    rules = signatures()
    words = F.trim(F.regexp_replace(ascii_lower(text_or_empty(text)), SEPARATORS, " "))
    df = df.select(*keep, words.alias("_words"))

    phrases = whole_words("|".join(p for p, _ in BASE_PHRASES))
    any_base = F.col("_words").contains("license") | F.col("_words").contains("cc by")
    none = F.array().cast("array<string>")
    df = df.select(
        *keep,
        "_words",
        F.when(any_base, F.regexp_extract_all("_words", F.lit(phrases), F.lit(0))).otherwise(none).alias("_hits"),
    )
    hit = F.size("_hits") > 0
    between = F.split("_words", phrases, -1)
    tail = F.char_length(F.element_at(between, -1)) + F.char_length(F.element_at("_hits", -1))
    before_last = F.substring(F.col("_words"), F.lit(1), (F.char_length("_words") - tail).cast("int"))
    labels = [F.when(F.array_contains("_hits", phrase), F.lit(label)) for phrase, label in BASE_PHRASES]

    gate = F.lit(False)
    for word in KEYWORDS:
        gate = gate | F.col("_words").contains(word)
    kind = "array<struct<first_word:bigint,end_word:bigint,label:string,priority:int,confidence:double>>"
    ordered_kind = "array<struct<first_word:bigint,minus_end:bigint,priority:int,label:string,confidence:double>>"
    # one literal for all rules: thousands of small ones would take longer to plan than to run
    rows = [
        {"keywords": r.keyword.split("|"), "pattern": whole_words(r.pattern), "label": r.label, "priority": i, "confidence": r.confidence}
        for i, r in enumerate(rules)
    ]
    shape = "array<struct<keywords:array<string>,pattern:string,label:string,priority:int,confidence:double>>"
    table = F.from_json(F.lit(json.dumps(rows)), shape)

    def places(rule: Column) -> Column:
        """Every match of a rule, its words counted up to it and through it."""
        found = F.regexp_extract_all(F.col("_words"), rule["pattern"], F.lit(0))

        def counted(hits: Column) -> Column:
            gaps = F.slice(F.split(F.col("_words"), rule["pattern"], -1), F.lit(1), F.size(hits))
            pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(_spaces_in(g).alias("gap"), _spaces_in(h).alias("hit")))

            def one(x: Column, at: Column) -> Column:
                first = at + x["gap"]
                return F.struct(
                    first.alias("first_word"), (-(first + x["hit"] + 1)).alias("minus_end"), rule["priority"].alias("priority"),
                    rule["label"].alias("label"), rule["confidence"].alias("confidence"),
                )

            placed = lambda ps: F.zip_with(ps, sums_before(F.transform(ps, lambda x: x["gap"] + x["hit"])), one)
            return F.when(F.size(hits) > 0, bound(pairs, placed)).otherwise(F.array().cast(ordered_kind))

        return bound(found, counted)

    wanted = F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.col("_words").contains(k)))
    ordered = F.array_sort(F.flatten(F.transform(wanted, places)))
    kept = F.transform(
        bound(bound(ordered, _outer), _settled),
        lambda d: F.struct(
            d["first_word"].alias("first_word"), (-d["minus_end"]).alias("end_word"), d["label"].alias("label"),
            d["priority"].alias("priority"), d["confidence"].alias("confidence"),
        ),
    )
    df = df.select(
        *keep,
        _words_in(F.col("_words")).alias("n_words"),
        F.size("_hits").cast("long").alias("n_base"),
        F.when(hit, _spaces_in(F.element_at(between, 1))).alias("first_word"),
        F.when(hit, _spaces_in(before_last)).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("_base"),
        F.when(gate, kept).otherwise(F.array().cast(kind)).alias("detections"),
    )
    all_labels = F.array_sort(F.array_union("_base", F.transform("detections", lambda d: d["label"])))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return df.select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, 0.6).otherwise(0.0)).alias("score"),
        "detections",
    )
