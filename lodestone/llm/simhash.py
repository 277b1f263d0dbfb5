"""SimHash near-duplicates by multi-index hashing.

Fingerprint: A-Z in lower case, words between ASCII white space, every run of
`shingle` words (repeats included, joined by a space) hashed by XXH64 with seed 42; a
bit is 1 if it is set in over half of the hashes. A text with fewer words is one
shingle; one without words has fingerprint zero and links like any other.

Links: fingerprints at most `radius` bits apart. A fingerprint is cut into segments;
two that are close agree in some segment up to a small distance. Each is stored in a
table for each segment and asks the tables for the small Hamming ball around its own
segment, and complete distances decide. Since a ball is symmetric, only the side with
more bits set needs to be looked up, so half of each ball is enumerated. With r =
`radius`, m segments and r = m * q + a, the first a + 1 segments need radius q and the
others q - 1.

Equal fingerprints are one node, so copies cost nothing here. Tables hold
fingerprints, never texts; a bucket beyond `bucket_limit` rows is dealt over several
tasks; each task passes on a forest of the links it found, not the pairs, which is
enough for components and loses none.

Defined results: a null text is the empty text; each row gives one row, repeated rows
included; rows whose id is null share its component's smallest id, null only if the
component has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm.buckets import map_groups, split_large
from lodestone.llm.common import cut, map_batches
from lodestone.llm.components import connected_components, forest

SEED = 42


def hashes(text: str, shingle: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and white space count
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)] if words else []
    runs = zip(*(words[k:] for k in range(shingle)), strict=False)
    return [digest(x, SEED) for x in map(b" ".join, runs)]


def fingerprints_of(texts: list[str | None], shingle: int) -> np.ndarray:
    """Unsigned 64-bit fingerprints; bits are summed in slices, so a long text needs no large table."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        h = np.array(hashes(text or "", shingle), dtype="<u8")
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), 65536):
            part = h[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = weights[2 * ones > len(h)].sum(dtype=np.uint64) if len(h) else 0
    return out


def fingerprint(df: DataFrame, keys: list[str], text: str = "text", shingle: int = 5) -> DataFrame:
    """(keys, fingerprint long): the 64 bits of each text, as a signed number."""

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        bits = fingerprints_of(batch.column(len(keys)).to_pylist(), shingle)
        return {k: batch.column(i) for i, k in enumerate(keys)} | {"fingerprint": pa.array(bits.view(np.int64))}

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", fingerprint bigint"
    return map_batches(df.select(*keys, text), schema, rows)


def segments_for(n: int, bits: int = 64) -> int:
    """Segments of about log2(n) bits, two at least, so that a bucket holds few strangers at any size."""
    return max(2, min(4, round(bits / max(16, n.bit_length()))))


def _plan(radius: int, segments: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment."""
    quotient, rest = divmod(radius, segments)
    cuts = [bits * k // segments for k in range(segments + 1)]
    return [
        (cuts[k], cuts[k + 1] - cuts[k], quotient if k <= rest else quotient - 1)
        for k in range(segments)
        if (quotient if k <= rest else quotient - 1) >= 0
    ]


def _probes(value: Column, width: int, radius: int) -> Column:
    """The segment itself and the members of its ball that differ from it in set order: `up` flips lead to larger balls' keys."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return F.transform(F.array(*(F.lit(f).cast("long") for f in flips)), lambda f: value.bitwiseXOR(f))


def _pairs_in(table: pa.Table, starts: np.ndarray, radius: int, small: int = 64) -> list[pa.RecordBatch]:
    """A forest of the links inside the groups of a table (bucket, part_a, part_b, fingerprint, home, side)."""
    value = table.column("fingerprint").to_numpy().view(np.uint64)
    home = table.column("home").to_numpy()
    side = table.column("side").to_numpy()
    sizes = np.diff(np.append(starts, len(value)))
    useful = (sizes > 1) & (np.add.reduceat(home, starts) > 0)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def take(x: np.ndarray, y: np.ndarray) -> None:
        ok = (home[x] | home[y]).astype(bool) & ((side[x] == 2) | (side[x] != side[y]))
        x, y = x[ok], y[ok]
        near = np.bitwise_count(value[x] ^ value[y]) <= radius
        x, y = value[x[near]].view(np.int64), value[y[near]].view(np.int64)
        left.append(x)
        right.append(y)
        if sum(map(len, left)) > 500_000:
            x, y = forest(np.concatenate(left), np.concatenate(right))
            left[:], right[:] = [x], [y]

    group = np.repeat(np.arange(len(starts)), sizes)
    rows = np.flatnonzero((useful & (sizes <= small))[group])
    step = 1
    while len(rows):  # neighbours one, two, three ... rows further on
        rows = rows[rows + step < len(value)]
        rows = rows[group[rows] == group[np.minimum(rows + step, len(value) - 1)]]
        take(rows, rows + step)
        step += 1
    for g in np.flatnonzero(useful & (sizes > small)):
        members = np.arange(starts[g], starts[g] + sizes[g])
        hosts = members[home[members] == 1]
        for at in range(0, len(hosts), 256):
            block = hosts[at : at + 256]
            near = np.bitwise_count(value[block][:, None] ^ value[members][None, :]) <= radius
            i, j = np.nonzero(near)
            take(block[i], members[j])
    if not left:
        return []
    x, y = forest(np.concatenate(left), np.concatenate(right))
    return [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])] if len(x) else []


def links(prints: DataFrame, radius: int, segments: int | None = None, bucket_limit: int = 20_000) -> DataFrame:
    """(a, b): a forest over the distinct `fingerprint` values whose components are those of all links within `radius`."""
    segments = segments or segments_for(prints.count())
    tables = []
    for k, (shift, width, ball) in enumerate(_plan(radius, segments)):
        own = F.shiftrightunsigned(F.col("fingerprint"), shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        asked = F.filter(_probes(own, width, ball), lambda p: p >= own)  # noqa: B023
        key = F.explode(asked).alias("_key")
        bucket = F.shiftleft(F.col("_key"), 3).bitwiseOR(F.lit(k).cast("long"))
        tables.append(
            prints.select("fingerprint", own.alias("_own"), key).select(
                bucket.alias("bucket"), "fingerprint", (F.col("_key") == F.col("_own")).cast("int").alias("home")
            )
        )
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    rows = split_large(rows, "bucket", "fingerprint", bucket_limit)
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return map_groups(rows, ["bucket", "part_a", "part_b"], schema, lambda t, starts: _pairs_in(t, starts, radius))


def _components(prints: DataFrame, key: str, radius: int, segments: int | None) -> DataFrame:
    """(fingerprint, component): the smallest fingerprint that each is connected with."""
    nodes = cut(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    found = connected_components(links(nodes, radius, segments)).withColumnRenamed("node", "fingerprint")
    joined = nodes.join(found, "fingerprint", "left")
    return cut(joined.withColumn("component", F.coalesce("component", "fingerprint")))


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 4, segments: int | None = None
) -> DataFrame:
    """(key, fingerprint long, component_id): the smallest id in each row's component of near-duplicates."""
    prints = cut(fingerprint(df, [key], text, shingle))
    parts = _components(prints, key, radius, segments)
    names = parts.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(parts.join(names, "component").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component_id")
