"""Language identification by string kernels.

A text is the sets of its character n-grams for n = 1, 2, 3 (blended spectrum; only
presence counts), each n-gram hashed into a table of that n. The kernel of two texts
is the mean over n of |common| / sqrt(|one| |other|). Landmarks are training texts of
every language; Nyström's method turns a text's kernel values with them into
coordinates, and one ridge regression for each language (1 for it, -1 for the rest)
is fitted there. Both steps are linear after the kernel values, so they are folded
into one matrix, and a batch is scored by two matrix products: presence by landmark
presence, kernel values by that matrix.

Training reads a bounded sample of every language: at most `per_language` rows and
`landmarks_each` landmarks of each, the rows smallest by a hash of their id. Of more than
`max_languages` languages the totals for that many are divided among all, so that each
has fewer (one row and one landmark at least, without which its alphabet would be
unknown); none is left out. What comes to the driver is packed
presence tables, 2.7 KB each whatever the text's length, and the languages' counts; they are
unpacked in slices.
Every document is then scored over its whole text.

Defined results: a null text, or one without a letter (Unicode category L), is `und` with score 0; rows
whose lang is null, or whose id is null, are not learned from; without any training
row all are `und`; each row gives one row, repeated rows included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import map_batches, one_text, small_table

#: n-gram length -> entries of its table
TABLES = {1: 1 << 10, 2: 1 << 12, 3: 1 << 14}
WIDTH = sum(TABLES.values())
_LETTER = regex.compile(r"\p{L}")


def presence(texts: list[str]) -> np.ndarray:
    """uint8 [texts, WIDTH]: which hashed n-grams each text has."""
    out = np.zeros((len(texts), WIDTH), dtype=np.uint8)
    flat = out.reshape(-1)
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    points = np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * WIDTH, lengths)
    start = 0
    value = np.zeros(len(points), dtype=np.uint64)
    for n, size in TABLES.items():
        k = len(points) - n + 1
        if k <= 0:
            break
        value = value[:k] * np.uint64(0x100000001B3) + points[n - 1 :]
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        place = (mixed >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)
        inside = row[:k] == row[n - 1 :]  # no n-gram runs over into the next text
        flat[(row[:k] + start + place)[inside]] = 1
        start += size
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # float32 [WIDTH, landmarks of each n side by side], already divided by the root of their sizes
    weights: np.ndarray  # float32 [landmarks, languages]
    offset: np.ndarray  # float32 [languages]

    def kernel(self, seen: np.ndarray) -> np.ndarray:
        total, start = 0.0, 0
        for size in TABLES.values():
            part = seen[:, start : start + size].astype(np.float32)
            own = np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1.0))
            total = total + (part @ self.landmarks[start : start + size]) / own
            start += size
        return total / len(TABLES)

    def scores(self, seen: np.ndarray) -> np.ndarray:
        return self.kernel(seen) @ self.weights + self.offset


def _landmark_matrix(seen: np.ndarray) -> np.ndarray:
    out, start = np.empty((WIDTH, len(seen)), dtype=np.float32), 0
    for size in TABLES.values():
        part = seen[:, start : start + size].astype(np.float32)
        out[start : start + size] = (part / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1.0))).T
        start += size
    return out


def train(bits: np.ndarray, languages: list[str], landmarks_each: int, ridge: float, slice_rows: int = 256) -> Model:
    """A model from packed presence rows, which are unpacked in slices: the regression needs sums over them only."""
    names, label = np.unique(np.array(languages), return_inverse=True)
    names = names.tolist()
    unpacked = lambda rows: np.unpackbits(bits[rows], axis=1, count=WIDTH)
    chosen = np.concatenate([np.flatnonzero(label == k)[:landmarks_each] for k in range(len(names))])
    none = np.zeros((len(chosen), len(names)), dtype=np.float32)
    model = Model(names, _landmark_matrix(unpacked(chosen)), none, none[0])
    slices = [np.arange(i, min(i + slice_rows, len(bits))) for i in range(0, len(bits), slice_rows)]
    among = np.concatenate([model.kernel(unpacked(chosen[i : i + slice_rows])) for i in range(0, len(chosen), slice_rows)]).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström coordinates are kernel values times this
    size = root.shape[1] + 1
    left, right = ridge * np.eye(size), np.zeros((size, len(names)))
    weight = 1.0 / np.bincount(label, minlength=len(names))  # languages count alike, whatever their number of rows
    for rows in slices:
        x = np.hstack([model.kernel(unpacked(rows)).astype(np.float64) @ root, np.ones((len(rows), 1))])
        weighted = x * weight[label[rows]][:, None]
        left += weighted.T @ x
        right += weighted.T @ np.where(label[rows][:, None] == np.arange(len(names)), 1.0, -1.0)
    solved = np.linalg.solve(left, right)
    model.weights = (root @ solved[:-1]).astype(np.float32)
    model.offset = solved[-1].astype(np.float32)
    return model


def fit(
    df: DataFrame,
    usable: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    max_languages: int = 64,
    landmarks_each: int = 16,
    ridge: float = 1e-3,
) -> Model | None:
    """A model from rows where `usable` holds; the ids and languages are chosen without reading texts."""
    known = usable & F.col(lang).isNotNull() & F.col(key).isNotNull()
    rows = df.filter(known).select(F.col(key).alias("_k"), F.col(lang).alias("_l"))
    counts = rows.groupBy("_l").agg(F.approx_count_distinct("_k").alias("n")).collect()
    if not counts:
        return None
    spark = df.sparkSession
    if len(counts) > max_languages:
        per_language = max(1, per_language * max_languages // len(counts))
        landmarks_each = max(1, landmarks_each * max_languages // len(counts))
    # a hash low enough for over four times the rows wanted, so that few rows of a frequent language are ranked
    low = F.shiftrightunsigned(F.xxhash64("_k"), 1)
    most = [(r._l, min(int(min(1.0, (4 * per_language + 60) / max(1, r.n)) * (1 << 63)), (1 << 63) - 1)) for r in counts]
    limits = F.broadcast(small_table(spark, most, "_l string, _most bigint"))
    first = W.partitionBy("_l").orderBy("_h", "_k")
    near = rows.withColumn("_h", low).join(limits, "_l").filter(F.col("_h") <= F.col("_most")).select("_l", "_k", "_h").distinct()
    chosen = near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_language)
    ids = sorted((r._k, r._l) for r in chosen.select("_k", "_l").collect())  # at most per_language * max_languages, or one for each language
    kind = df.schema[key].dataType.simpleString()
    wanted = F.broadcast(small_table(spark, ids, f"_k {kind}, _l string"))
    sample = df.filter(known).select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t")).join(wanted, ["_k", "_l"], "left_semi")
    sample = one_text(sample, ["_k", "_l"])  # ids that stand in many rows do not widen the bound

    def rows_of(batch: pa.RecordBatch) -> dict[str, object]:
        seen = presence([t or "" for t in batch.column(2).to_pylist()])
        bits = np.packbits(seen, axis=1)
        return {"_k": batch.column(0), "lang": batch.column(1), "bits": pa.array([b.tobytes() for b in bits], type=pa.binary())}

    got = map_batches(sample, f"_k {kind}, lang string, bits binary", rows_of, rows=128).collect()
    got.sort(key=lambda r: (r.lang, r._k))
    packed = np.empty((len(got), WIDTH // 8), dtype=np.uint8)  # 2.7 KB for a row of the sample
    for i, r in enumerate(got):
        packed[i] = np.frombuffer(r.bits, dtype=np.uint8)
    languages = [r.lang for r in got]
    del got
    return train(packed, languages, landmarks_each, ridge)


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the language of the highest regression, and (its value + 1) / 2 within 0 and 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # WIDTH * max_languages * landmarks_each numbers, or WIDTH for each language if that is more

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        model, texts = shared.value, [t or "" for t in batch.column(1).to_pylist()]
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        readable = [i for i, t in enumerate(texts) if _LETTER.search(t)]
        if model is not None and readable:
            f = model.scores(presence([texts[i] for i in readable]))
            best = f.argmax(axis=1)
            for i, k, v in zip(readable, best.tolist(), f.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = model.languages[k], min(1.0, max(0.0, (v + 1) / 2))
        return {key: batch.column(0), "lang_pred": pa.array(names), "score": pa.array(scores)}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"{key} {kind}, lang_pred string, score double", rows, rows=128)
