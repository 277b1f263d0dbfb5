"""Embedding near-duplicates by spherical-cap filters.

Each of several random rotations carries a structured random code: the turned vector is
cut into four blocks, each block has `codewords` random unit directions, and a filter is
one direction for each block, so `codewords` ** 4 filters are kept as 4 * `codewords`
short vectors. A vector's inner product with a filter is the sum of four block products.
List decoding gives the filters whose cap the vector lies in without trying all: the
highest sums of two lists can only come from the tops of both. The height is set for
each vector such that `list_size` filters are exceeded; one height for all would leave
some vectors in no cap and others in thousands. `codewords` grows with the fourth root
of the number of vectors, so that strangers seldom share a filter.

How often two vectors at the threshold share a filter of one rotation depends on the
dimension, the directions and the list alone, since a rotation turns any pair into a
random one. It is measured on random pairs before the work begins; rotations are then as
many as a miss of 1 in 500 asks for. Few dimensions hold few caps of that angle: where
over 12 rotations would be needed, directions are fewer instead, and a vector meets more
strangers, as it then has more true neighbours too.

Vectors meet in the filters they share, within a label, and every pair that meets is
verified by its cosine in double precision. Names of vectors and filters are shuffled
first; vectors follow only to filters that two or more share. Equal vectors of a label
are one node with a weight. A pair that shares several filters counts only in the first
of them, so the number of links is exact for all pairs found and no table of pairs is
ever written: a task passes on sums for each vector and a forest of links. Buckets
beyond `bucket_limit` vectors are dealt over several tasks.

Recall at cosine 0.98 itself, where it is lowest, of random pairs (tests measure it):
0.995 and more in 8, 16, 64 and 384 dimensions for 16 to 1,024 directions.

Defined results: vectors that are null, zero or of a null label, or that hold null or
non-finite components, have no links and are their own component; so are those whose
dimension differs from all others'. Rows of equal id are vectors of their own which
share the smallest id of either's component. A null id stays a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.buckets import map_groups, split_large
from lodestone.llm.common import cut, map_batches, told_apart
from lodestone.llm.components import connected_components, forest

BLOCKS = 4


class ProductCode:
    """Random filters for one dimension; the same seed gives the same filters everywhere."""

    def __init__(self, dimension: int, codewords: int, seed: int | list[int], rotations: int):
        rng = np.random.default_rng([*np.atleast_1d(seed), dimension])
        padded = -(-dimension // BLOCKS) * BLOCKS
        self.codewords = codewords
        self.turns, self.codes = [], []
        for _ in range(rotations):
            turn, _ = np.linalg.qr(rng.standard_normal((padded, padded)))
            words = rng.standard_normal((BLOCKS, codewords, padded // BLOCKS))
            self.turns.append(turn[:dimension])
            self.codes.append(words / np.linalg.norm(words, axis=2, keepdims=True))

    def decode(self, unit: np.ndarray, list_size: int) -> np.ndarray:
        """The `list_size` highest filters of each rotation for each row, as sorted numbers."""
        n, out = len(unit), []
        for number, (turn, words) in enumerate(zip(self.turns, self.codes, strict=True)):
            blocks = (unit @ turn).reshape(n, BLOCKS, -1)
            # a sum can be among the highest only if its parts are, so lists stay as short as the result
            lists = [_highest(blocks[:, b] @ words[b].T, list_size) for b in range(BLOCKS)]
            span = self.codewords
            while len(lists) > 1:
                lists = [_sums(x, y, span, list_size) for x, y in zip(lists[::2], lists[1::2], strict=True)]
                span *= span
            out.append(lists[0][0] + number * self.codewords**BLOCKS)
        return np.sort(np.concatenate(out, axis=1), axis=1)


def _highest(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the `most` highest of each row."""
    if values.shape[1] > most:
        places = np.argpartition(-values, most - 1, axis=1)[:, :most]
        return places.astype(np.int64), np.take_along_axis(values, places, 1)
    return np.tile(np.arange(values.shape[1], dtype=np.int64), (len(values), 1)), values


def _sums(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], span: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` highest sums of one entry of either list, named by both names."""
    names = (x[0][:, :, None] * span + y[0][:, None, :]).reshape(len(x[0]), -1)
    places, values = _highest((x[1][:, :, None] + y[1][:, None, :]).reshape(len(x[0]), -1), most)
    return np.take_along_axis(names, places, 1), values


def codewords_for(n: int) -> int:
    """Directions of a block such that there are 16 filters for each of `n` vectors, so that strangers seldom share one."""
    return max(16, math.ceil((16 * n) ** (1 / BLOCKS)))


def pairs_at(cosine: float, dimension: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and others at `cosine` from them."""
    rng = np.random.default_rng([seed, dimension])
    x = rng.standard_normal((n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dimension))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(z, length, out=np.zeros_like(z), where=length > 0)


def met(code: ProductCode, x: np.ndarray, y: np.ndarray, list_size: int) -> np.ndarray:
    """Whether the vectors of each pair share a filter."""
    a, b = code.decode(x, list_size), code.decode(y, list_size)
    return (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))


def rotations_for(dimension: int, codewords: int, least: float, list_size: int, seed: int, miss: float = 0.002, most: int = 12) -> tuple[int, int]:
    """(directions, rotations), so that of pairs at cosine `least` no more than `miss` share no filter."""
    pairs = 1_500
    x, y = pairs_at(least, dimension, pairs, seed + 1)
    while True:
        shared = np.mean([met(ProductCode(dimension, codewords, [seed, k + 1], 1), x, y, list_size).mean() for k in range(2)])
        shared = min(0.99, shared - math.sqrt(max(shared * (1 - shared), 1e-9) / pairs))
        rotations = math.ceil(math.log(miss) / math.log1p(-shared)) if shared > 0 else most + 1
        if rotations <= most or codewords <= 4:
            return codewords, max(4, min(rotations, 4 * most))
        codewords = max(4, int(codewords * 0.8))


def _units(vectors: np.ndarray) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _with_filters(nodes: DataFrame, codewords: int, least: float, list_size: int, seed: int) -> DataFrame:
    codes: dict[int, ProductCode] = {}
    # chosen once, here, so that all tasks have the same filters; a table has few dimensions
    shapes = {r.d: rotations_for(r.d, codewords, least, list_size, seed) for r in nodes.select(F.size("vector").alias("d")).distinct().collect()}

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        vectors = batch.column(1)
        lengths = np.diff(vectors.offsets.to_numpy())
        filters: list[list[int]] = [[] for _ in range(len(lengths))]
        for dimension in np.unique(lengths).tolist():
            if dimension not in codes:
                words, rotations = shapes[dimension]
                codes[dimension] = ProductCode(dimension, words, seed, rotations)
            code = codes[dimension]
            which = np.flatnonzero(lengths == dimension)
            x = vectors.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False).reshape(len(which), dimension)
            for i, f in zip(which.tolist(), code.decode(_units(x), list_size).tolist(), strict=True):
                filters[i] = f
        return {"node": batch.column(0), "filters": pa.array(filters, type=pa.list_(pa.int64()))}

    return map_batches(nodes.select("node", "vector"), "node bigint, filters array<bigint>", rows, rows=1024)


class _Found:
    """Links of each node, and a forest over them, kept short while a task goes on."""

    def __init__(self) -> None:
        self.nodes, self.links, self.left, self.right, self.held = [], [], [], [], 0

    def count(self, nodes: np.ndarray, links: np.ndarray) -> None:
        self.nodes.append(nodes)
        self.links.append(links)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        self.left.append(a)
        self.right.append(b)
        self.held += len(a)
        if self.held > 500_000:
            a, b = forest(np.concatenate(self.left), np.concatenate(self.right))
            self.left, self.right, self.held = [a], [b], 0

    def batches(self) -> list[pa.RecordBatch]:
        if not self.nodes:
            return []
        who, place = np.unique(np.concatenate(self.nodes), return_inverse=True)
        n = np.zeros(len(who), dtype=np.int64)
        np.add.at(n, place, np.concatenate(self.links))
        a, b = forest(np.concatenate(self.left), np.concatenate(self.right))
        arrays = [
            pa.concat_arrays([pa.array(who), pa.array(a)]),
            pa.concat_arrays([pa.nulls(len(who), pa.int64()), pa.array(b)]),
            pa.concat_arrays([pa.array(n), pa.nulls(len(a), pa.int64())]),
        ]
        return [pa.RecordBatch.from_arrays(arrays, names=["node", "other", "links"])]


def _verify(table: pa.Table, starts: np.ndarray, least: float, small: int = 64, block: int = 1024) -> list[pa.RecordBatch]:
    """How many vectors each links with where this filter is the first they share, and a forest of the links.

    Small groups are compared all together, a row with its first, second, third ...
    neighbour in its group; large ones block by block.
    """
    node, weight, side, own = (table.column(c).to_numpy() for c in ("node", "weight", "side", "filter"))
    vectors, lists = table.column("vector").combine_chunks(), table.column("filters").combine_chunks()
    sizes = np.diff(np.append(starts, len(node)))
    group = np.repeat(np.arange(len(starts)), sizes)
    length = np.diff(vectors.offsets.to_numpy())
    found = _Found()
    for dimension in np.unique(length).tolist():
        rows = np.flatnonzero(length == dimension)  # a group has one dimension
        pick = pa.array(rows)
        x = _units(vectors.take(pick).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dimension))
        f = lists.take(pick).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        of, ids, w, s, mine = group[rows], node[rows], weight[rows], side[rows], own[rows]

        def take(p: np.ndarray, q: np.ndarray, ids=ids, w=w, f=f, mine=mine) -> None:
            """Pairs that are near: those which share an earlier filter are counted there."""
            first = np.full(len(p), np.iinfo(np.int64).max)
            for k in range(f.shape[1]):
                column = f[p, k]
                first = np.where((f[q] == column[:, None]).any(axis=1), np.minimum(first, column), first)
            p, q = p[first == mine[p]], q[first == mine[p]]
            found.count(ids[p], w[q])
            found.count(ids[q], w[p])
            found.join(ids[p], ids[q])

        at = np.flatnonzero(sizes[of] <= small)
        step = 1
        while len(at):
            at = at[at + step < len(rows)]
            at = at[of[at] == of[at + step]]
            for some in range(0, len(at), 65536):
                p = at[some : some + 65536]
                q = p + step
                meet = (s[p] == 2) & (s[q] == 2) | (s[p] + s[q] == 1)
                p, q = p[meet], q[meet]
                near = np.einsum("ij,ij->i", x[p], x[q]) >= least
                if near.any():
                    take(p[near], q[near])
            step += 1
        begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        ends = np.append(begins[1:], len(of))
        for a, z in zip(begins.tolist(), ends.tolist(), strict=True):
            if z - a <= small:
                continue
            values = f[a:z].ravel()
            lower = values < mine[a]
            seen, column = np.unique(values[lower], return_inverse=True)
            member = np.zeros((z - a, len(seen)), dtype=np.float32)
            member[np.repeat(np.arange(z - a), f.shape[1])[lower], column] = 1
            links = np.zeros(z - a, dtype=np.int64)
            sides = s[a:z]
            for at in range(0, z - a, block):
                i = np.arange(at, min(at + block, z - a))
                near = x[a + i] @ x[a:z].T >= least
                near &= (sides[i, None] == 2) & (sides[None, :] == 2) | (sides[i, None] + sides[None, :] == 1)
                near[i - at, i] = False
                if not near.any():
                    continue
                near &= member[i] @ member.T == 0
                links[i] += near @ w[a:z]
                p, q = np.nonzero(near)
                p += at
                keep = p < q
                found.join(*forest(ids[a + p[keep]], ids[a + q[keep]]))
            found.count(ids[a:z][links > 0], links[links > 0])
    return found.batches()


def near_duplicates(
    df: DataFrame,
    least: float = 0.98,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    codewords: int | None = None,
    list_size: int = 6,
    bucket_limit: int = 300,
    seed: int = 4,
) -> DataFrame:
    """(key, n_links long, component_id, kept boolean), one row for each row of `df`.

    `codewords` is set by the number of vectors where it is not given.
    """
    narrow = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(key).alias("_id"), F.col(vector).cast(f"array<{narrow}>").alias("_v"), F.col(label).alias("_label"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("_label").isNotNull() & F.col("_v").isNotNull() & finite & F.exists("_v", lambda x: x != 0)
    # adding zero makes -0.0 the same as 0.0; a node is a label and a vector
    clean = F.when(F.coalesce(usable, F.lit(False)), F.transform("_v", lambda x: x + F.lit(0.0).cast(narrow)))
    rows = rows.select("_id", "_label", clean.alias("vector"))
    here = F.col("vector").isNotNull()
    rows = cut(
        rows.select(
            "_id", "vector", F.when(here, F.xxhash64("_label", "vector")).alias("node"),
            F.when(here, F.xxhash64("vector", "_label")).alias("check"), F.when(here, F.xxhash64("_label")).alias("group"),
        )
    )
    rows = told_apart(rows, "node", "check")
    nodes = cut(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.first("vector").alias("vector"), F.first("group").alias("group"), F.count("*").alias("weight"), F.min("_id").alias("least"))
    )
    codewords = codewords or codewords_for(nodes.count())
    filters = cut(_with_filters(nodes, codewords, least, list_size, seed).join(nodes.select("node", "group", F.size("vector").alias("dimension")), "node"))
    # vectors are only brought to filters that two and more share
    meetings = filters.select("node", F.explode("filters").alias("filter"), "group", "dimension")
    meetings = meetings.withColumn("bucket", F.xxhash64("group", "dimension", "filter"))
    shared = meetings.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket")
    meetings = split_large(cut(meetings.join(shared, "bucket", "left_semi")), "bucket", "node", bucket_limit)
    full = meetings.join(filters.select("node", "filters"), "node").join(nodes.select("node", "vector", "weight"), "node")
    schema = StructType.fromDDL("node bigint, other bigint, links bigint")
    found = cut(map_groups(full, ["bucket", "part_a", "part_b", "group", "dimension", "filter"], schema, lambda t, s: _verify(t, s, least), at_once=8_000))
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("other IS NOT NULL"), "node", "other")
    known = cut(nodes.select("node", "weight", "least").join(counts, "node", "left").join(parts, "node", "left"))
    known = known.withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(
        known.join(names, "component").select(
            "node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
        )
    )
    out = rows.select("_id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"),
    )
