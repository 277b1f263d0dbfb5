"""Groups of documents whose word shingles are similar: SimHash by multi-index hashing, and an exact way for what it cannot reach.

A document is its set of word shingles (XXH64 of each). Its SimHash fingerprint is cut
into segments of about log2(n) bits, half of each segment's Hamming ball is enumerated
and complete distances decide (`simhash.links`): that finds the pairs within `radius`
bits. Sets of a similarity of 0.8 differ in some 10 of 64 bits, where balls would hold
most of the corpus, so multi-index hashing alone would lose them. They meet by prefix
filtering: sets of a similarity of `least` or more share an element among the first n -
ceil(least * n) + 1 of each in any common order of all shingles, so every such pair meets
for certain. The order is by hash, with the shingles that are frequent in a sample of
documents last, so that few documents meet in one; any set of frequent ones is right.
Of documents that meet, sizes and a fingerprint of `WORDS` * 64 bits decide who is a
candidate: sets of a similarity of 0.8 differ in some 19 of 128 bits, with a deviation of
4, and random ones in 64; `CANDIDATE_BITS` = 42 is over five deviations above the first.
Small sets deviate more and are candidates at any distance.

Candidates are verified exactly by their sets, in two steps that follow a loose component
of candidates: every document against the component's first, which settles a group of
copies in work that is linear in it; then the documents that are open still, against all
of their component. Both steps deal large components over many tasks.

Defined results: null and wordless texts are equal to each other; of rows that agree in
id and text one stays; of a group the row of smallest id stays, null ids last. Rows and
sets are named by 128 bits of hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.buckets import map_groups, split_large
from lodestone.llm.common import cut, map_batches, told_apart
from lodestone.llm.components import connected_components, forest
from lodestone.llm.simhash import hashes, links

WORDS, CANDIDATE_BITS = 2, 42
SMALL = 16  # shingles; smaller sets are candidates whatever their distance
SAMPLE, FREQUENT = 10_000, 200_000  # documents asked for frequent shingles, and shingles kept of them
COLUMNS = 2048
ROW = "struct<a:bigint,b:bigint>"
BROADCAST_ROWS = 500_000  # pairs of longs, about 25 MB
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(WORDS)], dtype=np.uint64)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """uint64 [WORDS] of shingle hashes: each bit is 1 if set in over half of the hashes; they are mixed for all words but the first."""
    out = np.zeros(WORDS, dtype=np.uint64)
    if not len(h):
        return out
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k in range(WORDS):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 32768):
            x = h[at : at + 32768]
            if k:
                x = x * _ODD[k]
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[k] = weights[2 * ones > len(h)].sum(dtype=np.uint64)
    return out


def _ordered_prefix(h: np.ndarray, least: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The elements of a sorted set by which it meets all sets of similarity `least`; frequent ones come last, by rank."""
    keep = len(h) - math.ceil(least * len(h) - 1e-9) + 1 if len(h) else 0
    if len(h) and len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        often = frequent[at] == h
        h = np.concatenate([h[~often], h[often][np.argsort(rank[at[often]])]])
    return h[:keep]


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingle hashes, rank of each by number of documents) of those that stand in four sampled documents or more."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.filter(F.shiftrightunsigned(F.xxhash64("_row"), 1) <= min(int(share * (1 << 63)), (1 << 63) - 1))

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        every = [np.unique(np.array(hashes(t or "", shingle), dtype="<u8")) for t in batch.column(0).to_pylist()]
        return {"h": pa.array(np.concatenate(every).view(np.int64))}

    counts = map_batches(some.select("_text"), "h bigint", rows).groupBy("h").agg(F.count("*").alias("n")).filter("n >= 4")
    found = np.array([r.h for r in counts.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], -order


def _fingerprints(df: DataFrame, shingle: int, least: float) -> DataFrame:
    """(_row, _key, node, check, size, fingerprint, print binary, prefix binary) of (_row, _key, _text); rows of equal shingle sets are one node."""
    shared = df.sparkSession.sparkContext.broadcast(_frequent(df, shingle))  # FREQUENT pairs of longs at most

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        every = [np.unique(np.array(hashes(t or "", shingle), dtype="<u8")) for t in batch.column(2).to_pylist()]
        names = [np.array([xxhash.xxh64_intdigest(h.tobytes(), seed) for h in every], dtype=np.uint64).view(np.int64) for seed in (0, 1)]
        prints = np.array([wide_fingerprint(h) for h in every]).reshape(-1, WORDS)
        return {
            "_row": batch.column(0), "_key": batch.column(1), "node": pa.array(names[0]), "check": pa.array(names[1]),
            "size": pa.array([len(h) for h in every], type=pa.int64()),
            "fingerprint": pa.array(prints[:, 0].copy().view(np.int64)),
            "print": pa.array([p.tobytes() for p in prints], type=pa.binary()),
            "prefix": pa.array([_ordered_prefix(h, least, *shared.value).tobytes() for h in every], type=pa.binary()),
        }

    kind = df.schema["_key"].dataType.simpleString()
    schema = f"_row {ROW}, _key {kind}, node bigint, check bigint, size bigint, fingerprint bigint, print binary, prefix binary"
    return map_batches(df.select("_row", "_key", "_text"), schema, rows, rows=128)


def _within_radius(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): a forest of the nodes whose 64-bit fingerprints are at most `radius` bits apart, by multi-index hashing."""
    first = cut(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fingerprint").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    names = [first.select(F.col("fingerprint").alias(side), F.col("first").alias(f"_{side}")) for side in ("a", "b")]
    near = links(first, radius).join(names[0], "a").join(names[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return same.unionByName(near)


def _meetings(nodes: DataFrame) -> DataFrame:
    """(bucket, node, size, head binary): one row for each shingle of the prefix, with the fingerprint to measure distances by."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        packed = batch.column(3).to_pylist()
        owner = pa.array(np.repeat(np.arange(len(packed)), [len(p) // 8 for p in packed]))
        bucket = pa.array(np.frombuffer(b"".join(packed), dtype="<i8"))
        return {"bucket": bucket, "node": batch.column(0).take(owner), "size": batch.column(1).take(owner), "head": batch.column(2).take(owner)}

    return map_batches(nodes.select("node", "size", "print", "prefix"), "bucket bigint, node bigint, size bigint, head binary", rows, rows=128)


def _heads(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, WORDS)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _near(head_x: np.ndarray, head_y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs can reach `least` by their sizes, and are small or of near fingerprints."""
    low = np.minimum(size_x, size_y)
    return (low >= least * np.maximum(size_x, size_y) - 1e-9) & ((low < SMALL) | (_far(head_x, head_y) <= CANDIDATE_BITS))


def _meet(side: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (side[x] == 2) | (side[x] != side[y])


def _batch(a: np.ndarray, b: np.ndarray) -> list[pa.RecordBatch]:
    return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])] if len(a) else []


def _loose(table: pa.Table, starts: np.ndarray, least: float, small: int = 48) -> list[pa.RecordBatch]:
    """A forest of the pairs in each group whose sizes and distance are near enough."""
    node, head, side = table.column("node").to_numpy(), _heads(table.column("head")), table.column("side").to_numpy()
    many = table.column("size").to_numpy()
    sizes = np.diff(np.append(starts, len(node)))
    group = np.repeat(np.arange(len(starts)), sizes)
    left, right = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def take(x: np.ndarray, y: np.ndarray) -> None:
        ok = _meet(side, x, y)
        x, y = x[ok], y[ok]
        near = _near(head[x], head[y], many[x], many[y], least)
        left.append(node[x[near]])
        right.append(node[y[near]])
        if sum(map(len, left)) > 500_000:
            x, y = forest(np.concatenate(left), np.concatenate(right))
            left[:], right[:] = [x], [y]

    rows, step = np.flatnonzero((sizes <= small)[group]), 1
    while len(rows):
        rows = rows[rows + step < len(node)]
        rows = rows[group[rows] == group[rows + step]]
        take(rows, rows + step)
        step += 1
    for g in np.flatnonzero(sizes > small):
        members = np.arange(starts[g], starts[g] + sizes[g])
        for at in range(0, len(members), 32):
            block = members[at : at + 32]
            rest = members[at:]
            near = _near(head[block][:, None, :], head[rest][None, :, :], many[block][:, None], many[rest][None, :], least)
            i, j = np.nonzero(near)
            i, j = block[i], members[at + j]
            take(i[i < j], j[i < j])
    return _batch(*forest(np.concatenate(left), np.concatenate(right)))


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` or more; two empty ones do."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (len(x) + len(y) - common) - 1e-9


def _like_first(sets: DataFrame, least: float) -> DataFrame:
    """`sets` (node, bucket, head, shingles) with `done`: whether a set is alike to the one of its component's smallest node, whose number the component has."""
    first = sets.filter("node = bucket").select("bucket", F.col("shingles").alias("first"))

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
        return {"node": batch.column(0), "done": pa.array([_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least) for x, y in pairs], type=pa.bool_())}

    joined = sets.join(first, "bucket").select("node", "shingles", "first")
    return map_batches(joined, "node bigint, done boolean", rows, rows=128)


def _deal_open(sets: DataFrame, limit: int) -> DataFrame:
    """Rows of components with open sets, dealt so that every open set meets all others of its component once.

    Open sets are cut into parts of about `limit`, and so are the others; a cell holds a
    part of open sets (side 0, or 2 with itself) and another part of open sets or one of
    the others (side 1). Sets that are done already do not meet each other.
    """
    sizes = sets.groupBy("bucket").agg(F.count_if(~F.col("done")).alias("_open"), F.count_if("done").alias("_rest")).filter("_open > 0")
    parts = lambda n: F.ceil(F.col(n) / limit).cast("int")
    sizes = cut(sizes.select("bucket", parts("_open").alias("_a"), parts("_rest").alias("_r")))
    own = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.when(F.col("done"), F.col("_r")).otherwise(F.col("_a"))).cast("int")
    cell = lambda a, b, side: F.struct(a.cast("int").alias("part_a"), b.cast("int").alias("part_b"), side.cast("int").alias("side"))
    many = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("_own")
    with_open = F.transform(
        many("_a"), lambda o: cell(F.least(mine, o), F.greatest(mine, o), F.when(mine == o, 2).when(mine < o, 0).otherwise(1))
    )
    with_rest = F.transform(many("_r"), lambda r: cell(mine, -1 - r, F.lit(0)))
    of_rest = F.transform(many("_a"), lambda o: cell(o, -1 - mine, F.lit(1)))
    spread = F.explode(F.when(F.col("done"), of_rest).otherwise(F.concat(with_open, with_rest))).alias("_p")
    return sets.join(sizes, "bucket").withColumn("_own", own).select("bucket", "node", "head", "shingles", spread).select("bucket", "node", "head", "shingles", "_p.*")


def _verified(table: pa.Table, starts: np.ndarray, least: float, block: int = 128) -> list[pa.RecordBatch]:
    """A forest of the pairs in each group whose shingle sets are alike."""
    node, head, side = table.column("node").to_numpy(), _heads(table.column("head")), table.column("side").to_numpy()
    packed = table.column("shingles").to_pylist()
    left, right = [], []
    for a, z in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist(), strict=True):
        if z - a < 2:
            continue
        sets = [np.frombuffer(p, dtype="<u8") for p in packed[a:z]]
        sizes = np.array([len(s) for s in sets])
        # shingles thrown into columns: a product of two rows is at least the number of common shingles
        cells = np.repeat(np.arange(z - a), sizes) * COLUMNS + (np.concatenate(sets) % np.uint64(COLUMNS)).astype(np.int64)
        thrown = np.bincount(cells, minlength=(z - a) * COLUMNS).astype(np.float32).reshape(z - a, COLUMNS)
        parent = np.arange(z - a)
        for at in range(0, z - a, block):
            i = np.arange(at, min(at + block, z - a))
            bound = thrown[i] @ thrown.T
            possible = bound >= least / (1 + least) * (sizes[i, None] + sizes[None, :]) - 0.5
            possible &= (side[a + i, None] != side[None, a:z]) | (side[a + i, None] == 2)
            possible &= np.arange(z - a)[None, :] > i[:, None]
            x, y = np.nonzero(possible)
            x += at
            near = _near(head[a + x], head[a + y], sizes[x], sizes[y], least)
            for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
                if parent[p] != parent[q] and _alike(sets[p], sets[q], least):
                    old, new = max(parent[p], parent[q]), min(parent[p], parent[q])
                    parent[parent == old] = new
                    left.append(node[a + p])
                    right.append(node[a + q])
    return _batch(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))


def _having(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of `df` whose `_row` is in `keys`; the keys are broadcast up to a checked number, joined beyond it."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "_row", "left_semi")


def _shingle_sets(df: DataFrame, shingle: int) -> DataFrame:
    """(_row, shingles binary): the sorted distinct shingle hashes of each text."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        sets = [np.unique(np.array(hashes(t or "", shingle), dtype="<u8")).tobytes() for t in batch.column(1).to_pylist()]
        return {"_row": batch.column(0), "shingles": pa.array(sets, type=pa.binary())}

    return map_batches(df.select("_row", "_text"), f"_row {ROW}, shingles binary", rows, rows=128)


def keep_one(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    least: float = 0.8,
    radius: int = 4,
    bucket_limit: int = 20_000,
    open_limit: int = 120,
) -> DataFrame:
    """The row of smallest id of each group of similar documents, all columns of `df` as they are.

    A bucket of candidates beyond `bucket_limit` documents is dealt over several tasks, and
    so are the open sets of a component beyond `open_limit`.
    """
    # the document is one column from here on, so its columns may have any names
    row = F.struct(F.xxhash64(key, text).alias("a"), F.xxhash64(text, key).alias("b"))
    marked = df.select(F.struct(*df.columns).alias("_doc"), row.alias("_row"))
    texts = marked.select("_row", F.col(f"_doc.{key}").alias("_key"), F.col(f"_doc.{text}").alias("_text"))
    prints = told_apart(cut(_fingerprints(texts, shingle, least)), "node", "check")
    ordered = F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_row").alias("r"))
    nodes = cut(prints.groupBy("node").agg(F.min(ordered).alias("m"), *(F.min(c).alias(c) for c in ("size", "fingerprint", "print", "prefix"))))
    schema = StructType.fromDDL("a bigint, b bigint")
    keys = ["bucket", "part_a", "part_b"]

    rows = split_large(_meetings(nodes), "bucket", "node", bucket_limit)
    meeting = map_groups(rows, keys, schema, lambda t, s: _loose(t, s, least), at_once=50_000)
    loose = cut(connected_components(_within_radius(nodes, radius).unionByName(meeting)))

    members = cut(loose.join(nodes, "node").select("node", F.col("component").alias("bucket"), F.col("m.r").alias("_row"), F.col("print").alias("head")))
    sets = cut(_shingle_sets(_having(texts, members.select("_row")), shingle).dropDuplicates(["_row"]))
    sets = cut(members.join(sets, "_row").drop("_row"))
    settled = cut(_like_first(sets, least))
    alike = settled.filter("done").join(members, "node").select(F.col("node").alias("a"), F.col("bucket").alias("b"))
    strict = map_groups(_deal_open(sets.join(settled, "node"), open_limit), keys, schema, lambda t, s: _verified(t, s, least), at_once=2_000)
    parts = connected_components(alike.unionByName(strict))

    named = nodes.join(parts, "node", "left").select("m", F.coalesce("component", "node").alias("component"))
    chosen = cut(named.groupBy("component").agg(F.min("m").alias("m")).select(F.col("m.r").alias("_row")))
    # rows that agree in id and text have one name: only those are numbered, in a side table without texts
    twice = cut(prints.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1").select("_row"))
    kept = _having(marked, chosen)
    if not twice.isEmpty():
        once = W.partitionBy("_row").orderBy("_row")
        several = kept.join(twice, "_row", "left_semi").withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
        kept = kept.join(twice, "_row", "left_anti").unionByName(several)
    return kept.select("_doc.*")
