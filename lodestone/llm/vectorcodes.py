"""Product codes of vectors: each part of a vector is named by the nearest entry of a codebook.

Components become integers, so distances are exact and every machine gives the same codes.
Codebooks are bettered by rounds of assignment and averaging. From its first, full scan
every vector part keeps, for each group of entries, the smallest distance that it had to
the group and the round of that scan. The driver keeps all codebooks so far. In a later
round a group can be left out if that distance less the group's net displacement since that
round, the largest distance between an entry then and the same entry now, is more than the
distance to the best entry known: the net way is never longer than the sum of the ways of
single rounds. Only groups that may hold the nearest entry are scanned again, and the
part's own group always.

Each round is one pass that writes the vectors with their bounds to the shared folder; sums
of parts are added up in tasks, then by Spark. Through the driver pass the first vectors
and the sums of the codebooks: `entries` vectors and as many sums, whatever the table's
size.

Defined results: vectors that are null or hold null or non-finite components are left out,
and so are those whose dimension is no positive multiple of `parts` or not that of the
first vector, by id, which has one that is. Null ids come last; of equal ids the smaller
vector comes first. With fewer vectors than `entries` there are as many entries as vectors.
Integers are cut off at 2 ** 25, so that an error stays in 64 bits up to 2,000 dimensions; sums over a label that do
not fit are the largest long. Repeated rows are rows of their own; no vectors, no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, forget, map_batches

GROUP = 8
MOST = 1 << 25
SAFE = 1 - 1e-9


def integers(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x), cut off at MOST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -MOST, MOST).astype(np.int64)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of x [..., width] to entries [..., e, width]."""
    out = np.zeros(np.broadcast_shapes(x.shape[:-1] + (1,), entries.shape[:-1]), dtype=np.int64)
    for j in range(x.shape[-1]):
        gap = x[..., None, j] - entries[..., j]
        out += gap * gap
    return out


def _below(d: np.ndarray) -> np.ndarray:
    """Distances of squared ones, as float32 never above the truth."""
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(-1))


class Bounds:
    """What a block of vectors knows: own entry, and for each group a distance and the round it was measured in."""

    def __init__(self, entry: np.ndarray, low: np.ndarray, stamp: np.ndarray):
        self.entry, self.low, self.stamp = entry, low, stamp  # [n, parts], [n, parts, groups] twice


def first_scan(x: np.ndarray, book: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """Bounds and distances of x [n, parts, width] from all entries of book [parts, entries, width]."""
    d = squared(x, book[None])
    entry = d.argmin(axis=2)  # the first of equal ones
    low = np.stack([_below(d[:, :, g : g + GROUP].min(axis=2)) for g in range(0, book.shape[1], GROUP)], axis=2)
    return Bounds(entry, low, np.zeros(low.shape, dtype=np.uint8)), np.take_along_axis(d, entry[:, :, None], 2)[:, :, 0]


def net_displacements(history: list[np.ndarray]) -> np.ndarray:
    """[rounds, parts, groups]: how far any entry of a group is from where it was in each round, never below the truth."""
    now = history[-1]
    way = np.stack([np.sqrt(((now - then) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-9) for then in history])
    return np.stack([way[:, :, g : g + GROUP].max(axis=2) for g in range(0, now.shape[1], GROUP)], axis=2)


def next_scan(x: np.ndarray, known: Bounds, history: list[np.ndarray]) -> tuple[Bounds, np.ndarray, int]:
    """Bounds and distances by the newest codebook of `history`, and how many distances were measured."""
    book, n, parts = history[-1], x.shape[0], x.shape[1]
    groups, moved, measured = known.low.shape[2], net_displacements(history), 0
    best = np.full((n, parts), np.iinfo(np.int64).max)
    entry = np.full((n, parts), book.shape[1])
    low, stamp, own = known.low.copy(), known.stamp.copy(), known.entry // GROUP
    place = np.arange(parts)[None, :]

    def scan(rows: np.ndarray, part: np.ndarray, g: np.ndarray) -> None:
        nonlocal measured
        for k in np.unique(g).tolist():
            pick = g == k
            r, p = rows[pick], part[pick]
            d = squared(x[r, p], book[p, k * GROUP : (k + 1) * GROUP])
            measured += d.size
            at = d.argmin(axis=1)
            least = d[np.arange(len(r)), at]
            low[r, p, k], stamp[r, p, k] = _below(least), len(history) - 1
            name = at + k * GROUP
            better = (least < best[r, p]) | (least == best[r, p]) & (name < entry[r, p])
            best[r[better], p[better]], entry[r[better], p[better]] = least[better], name[better]

    every = np.indices((n, parts)).reshape(2, -1)
    scan(every[0], every[1], own.ravel())
    for k in range(groups):
        nearest = known.low[:, :, k] - moved[known.stamp[:, :, k], place, k]
        far = (nearest > 0) & (nearest * nearest * SAFE > best)
        rows, part = np.nonzero(~far & (own != k))
        scan(rows, part, np.full(len(rows), k))
    return Bounds(entry, low, stamp), best, measured


def _packed(x: np.ndarray, kind: str) -> pa.Array:
    """One binary value for each row of x."""
    flat = np.ascontiguousarray(x.astype(kind)).reshape(len(x), -1)
    size = flat.shape[1] * flat.dtype.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def _unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
    start = int(offsets[column.offset])  # all values are as long and follow each other
    return np.frombuffer(column.buffers()[2], dtype=kind, count=len(column) * int(np.prod(shape)), offset=start).reshape(len(column), *shape)


def _sums(state: DataFrame, parts: int, width: int, entries: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sums of its components); a task passes on one row for each at most a batch."""
    names = [f"s{j}" for j in range(width)]

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        x = _unpacked(batch.column(0), "<i4", parts, width)
        at = _unpacked(batch.column(1), "u1", parts).astype(np.int64) + np.arange(parts) * entries
        count = np.bincount(at.ravel(), minlength=parts * entries)
        used = np.flatnonzero(count)
        sums = np.zeros((parts * entries, width), dtype=np.int64)
        np.add.at(sums, at.ravel(), x.reshape(-1, width))
        return {"part": used // entries, "entry": used % entries, "n": count[used], **{c: sums[used, j] for j, c in enumerate(names)}}

    schema = ", ".join(f"{c} bigint" for c in ("part", "entry", "n", *names))
    found = map_batches(state.select("parts", "entry"), schema, rows, rows=65_536).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names)))
    return {(r.part, r.entry): (r.n, [r[c] for c in names]) for r in found.collect()}  # a row for each entry


def _averaged(book: np.ndarray, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> np.ndarray:
    out = book.copy()
    for (part, entry), (n, total) in sums.items():
        out[part, entry] = [s // n for s in total]
    return out


def encode(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code string, error long), codebooks [parts, entries, width]); at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.select(F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).alias("_v"))
    kept = kept.filter(F.col("_v").isNotNull() & finite & (F.size("_v") > 0) & (F.size("_v") % parts == 0))
    order = [F.asc_nulls_last("_id"), F.asc("_v")]
    head = kept.orderBy(*order).limit(1).collect()
    kinds = {n: df.schema[c].dataType.simpleString() for n, c in (("_id", key), ("_label", label))}
    if not head:
        nothing = kept.select(F.col("_id").alias(key), F.col("_label").alias(label), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing.limit(0), np.zeros((parts, 0, 0), dtype=np.int64)
    width = len(head[0]._v) // parts
    kept = kept.filter(F.size("_v") == width * parts)
    start = np.array([r._v for r in kept.orderBy(*order).limit(entries).collect()], dtype=np.float64)
    history = [integers(start, scale).reshape(len(start), parts, width).transpose(1, 0, 2)]
    count = len(start)
    groups = -(-count // GROUP)
    kept_state = f"_id {kinds['_id']}, _label {kinds['_label']}, parts binary, entry binary, low binary, stamp binary"

    def written(batch: pa.RecordBatch, x: np.ndarray, known: Bounds) -> dict[str, object]:
        return {
            "_id": batch.column(0), "_label": batch.column(1), "parts": _packed(x, "<i4"), "entry": _packed(known.entry, "u1"),
            "low": _packed(known.low, "<f4"), "stamp": _packed(known.stamp, "u1"),
        }

    def begin(batch: pa.RecordBatch) -> dict[str, object]:
        x = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, parts, width)
        return written(batch, x, first_scan(x, history[0])[0])

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, Bounds]:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        x = _unpacked(at["parts"], "<i4", parts, width).astype(np.int64)
        entry = _unpacked(at["entry"], "u1", parts).astype(np.int64)
        return x, Bounds(entry, _unpacked(at["low"], "<f4", parts, groups), _unpacked(at["stamp"], "u1", parts, groups))

    def again(batch: pa.RecordBatch) -> dict[str, object]:
        x, known = read(batch)
        return written(batch, x, next_scan(x, known, books)[0])

    def finish(batch: pa.RecordBatch) -> dict[str, object]:
        x, known = read(batch)
        known, error, _ = next_scan(x, known, books)
        return {"_id": batch.column(0), "_label": batch.column(1), "code": [row.tobytes().hex() for row in known.entry.astype("u1")], "error": error.sum(axis=1)}

    state = cut(map_batches(kept, kept_state, begin))
    for r in range(rounds):
        history.append(_averaged(history[-1], _sums(state, parts, width, count)))
        books = list(history)  # a few codebooks, which travel with the function
        if r < rounds - 1:
            old, state = state, cut(map_batches(state, kept_state, again))
            forget(old)
    if not rounds:
        books = [*history, history[-1]]
    coded = map_batches(state, f"_id {kinds['_id']}, _label {kinds['_label']}, code string, error bigint", finish)
    return coded.select(F.col("_id").alias(key), F.col("_label").alias(label), "code", "error"), history[-1]


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **given: int) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): codes with the error of each vector and of all of its label."""
    coded, books = encode(df, key, vector, label, **given)
    coded = cut(coded.withColumnRenamed(label, "_label"))
    # sums are written, so that Spark can split a label of very many vectors where they are joined
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    by_label = cut(coded.groupBy(F.col("_label").alias("_same")).agg(total.alias("label_error")))
    joined = coded.join(by_label, F.col("_label").eqNullSafe(F.col("_same")))
    return joined.select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
