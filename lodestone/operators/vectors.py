"""Exact nearest vectors without reading all of them.

Vectors are packed as float32 and lie in folders by the nearest of some pivots, sorted by
their distance from it. By the triangle inequality a vector is at least as far from a query
as the query's distance from the pivot differs from the vector's. Many queries are answered
in two passes: the clusters whose pivots are nearest give every query a distance that the
k-th neighbour cannot exceed; then only clusters that may hold something nearer are opened,
and in them only vectors whose distance from the pivot fits. Sorted files let Spark skip the
row groups of others. Results are those of a scan of everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.sources.store import Store, Transaction

#: Relative slack of bounds, far above what rounding of float64 can amount to.
SLACK = 1e-9


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as little-endian float32."""
    return [row.tobytes() for row in np.ascontiguousarray(x, dtype="<f4")]


def unpacked(values: list[bytes], dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<f4").reshape(len(values), dimension)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x from the one vector y, in double precision."""
    gap = x.astype(np.float64) - y
    return np.sqrt((gap * gap).sum(axis=1))


def _pivots(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """A few rounds of k-means over the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:count]].astype(np.float64)
    for _ in range(4):
        d = (sample**2).sum(axis=1)[:, None] - 2 * sample @ centres.T + (centres**2).sum(axis=1)
        nearest = d.argmin(axis=1)
        for c in range(len(centres)):
            own = sample[nearest == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def build(tx: Transaction, df: DataFrame, key: str, vector: Column, name: str = "vectors", pivots: int | None = None, sample: int = 4_096, seed: int = 7) -> None:
    """Store the vectors of `df` anew; rows without one are left out, one of another dimension ends the job.

    Pivots, 1,024 at most, come from a sample of bounded size by a hash of the key; every
    vector is stored whatever they are.
    """
    rows = df.select(F.col(key).alias("key"), vector.alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("key"), "key").limit(sample).collect()
    dimension = len(chosen[0].v) if chosen else 0
    same = [r.v for r in chosen if len(r.v) == dimension]
    some = np.array(same, dtype=np.float64).reshape(len(same), dimension)
    count = min(pivots or int(min(1024, max(1, np.sqrt(n)))), max(1, len(some)))
    centres = _pivots(some, count, seed) if len(some) else np.zeros((1, 0))
    kind = rows.schema["key"].dataType.simpleString()
    ship(tx.store.spark)

    def assign(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            if (sizes != dimension).any():
                raise ValueError(f"a vector has not {dimension} components but {sizes[sizes != dimension][0]}")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), dimension).astype("<f4")
            d = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)
            nearest = d.argmin(axis=1)
            gap = x - centres[nearest]
            arrays = [batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(np.sqrt((gap * gap).sum(axis=1))), pa.array(packed(x), type=pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "cluster", "radius", "packed"])

    shape = StructType.fromDDL(f"key {kind}, cluster int, radius double, packed binary")
    tx.tables.pop(f"{name}_rows", None)
    tx.create(f"{name}_rows", shape, ["cluster"], count)
    tx.append(f"{name}_rows", rows.mapInArrow(assign, shape), F.col("cluster"), ["cluster", "radius"])
    part = tx.store.spark.read.parquet(*(tx.store._part(f"{name}_rows", p["part"]) for p in tx.tables[f"{name}_rows"]["rows"])) if n else None
    spread = {r.cluster: r for r in part.groupBy("cluster").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.count("*").alias("n")).collect()} if n else {}
    found = [(c, packed(centres[c : c + 1])[0], centres[c].tolist(), r.low, r.high, r.n) for c, r in sorted(spread.items())]
    shape = StructType.fromDDL("cluster int, packed binary, pivot array<double>, low double, high double, n bigint")
    tx.tables.pop(f"{name}_pivots", None)
    tx.create(f"{name}_pivots", shape, ["cluster"], 1)
    if found:
        tx.append(f"{name}_pivots", tx.store.spark.createDataFrame(found, shape))
    tx.values[f"{name}_dimension"] = dimension


def write(df: DataFrame, path: str, key: str, vector: Column, **given) -> None:
    Store(df.sparkSession, path).transact(lambda tx: build(tx, df, key, vector, **given))


def vectors(spark: SparkSession, path: str, name: str = "vectors") -> DataFrame:
    """(key, vector array<float>) as stored."""
    store = Store(spark, path)
    at = store.version()
    dimension = at.values[f"{name}_dimension"]
    ship(spark)

    def run(batches):
        for batch in batches:
            x = unpacked(batch.column(1).to_pylist(), dimension)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, dimension), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "vector"])

    rows = store.read(f"{name}_rows", at).select("key", "packed")
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, vector array<float>")


def _scan(rows: DataFrame, queries: np.ndarray, wanted: dict[int, list[tuple[int, float, float]]], k: int) -> DataFrame:
    """(query, key, distance, read): of the clusters in `wanted`, cluster -> (query, least and most radius), each query's k nearest in every task."""
    reach = [(c, min(lo for _, lo, _ in w), max(hi for _, _, hi in w)) for c, w in wanted.items()]
    # clusters by folder; their ranges are a small table, as a condition for each would nest a thousand deep
    near = F.col("_bucket").isin([c for c, _, _ in reach]) & F.col("radius").between(min((lo for _, lo, _ in reach), default=0.0), max((hi for *_, hi in reach), default=0.0))
    ranges = rows.sparkSession.createDataFrame(reach, "cluster int, _low double, _high double")
    found = rows.filter(near).join(F.broadcast(ranges), "cluster").filter(F.col("radius").between(F.col("_low"), F.col("_high"))).select("key", "cluster", "radius", "packed")
    kind = rows.schema["key"].dataType.simpleString()
    dimension = queries.shape[1]

    def run(batches):
        kept: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            keys, cluster, radius = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = unpacked(batch.column(3).to_pylist(), dimension)
            for c in np.unique(cluster).tolist():
                own = np.flatnonzero(cluster == c)
                for q, lo, hi in wanted[c]:
                    some = own[(radius[own] >= lo) & (radius[own] <= hi)]
                    if not len(some):
                        continue
                    names, d = kept.get(q, ([], np.zeros(0)))
                    names = names + [keys[i] for i in some.tolist()]
                    d = np.concatenate([d, _distances(x[some], queries[q])])
                    best = sorted(range(len(d)), key=lambda i: (d[i], names[i]))[:k]  # noqa: B023
                    kept[q] = ([names[i] for i in best], d[best])
        for q, (names, d) in kept.items():
            arrays = [pa.array([q] * len(names), type=pa.int32()), pa.array(names, type=batch.schema.field(0).type), pa.array(d)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query", "key", "distance"])

    return found.mapInArrow(run, f"query int, key {kind}, distance double")


def nearest(spark: SparkSession, path: str, queries: list[list[float]], k: int, name: str = "vectors", report: dict | None = None) -> DataFrame:
    """(query, key, distance, rank) of the k nearest stored vectors of each query, by number from 0; ties stand by key.

    A batch of queries is bounded by its caller, as are pivots: both are at hand in every task.
    `report` takes the numbers of `vectors`, of the pairs of a query and a vector that lie in
    opened clusters and ranges, and of `clusters` opened.
    """
    store = Store(spark, path)
    at = store.version()
    points = np.array(queries, dtype=np.float64)
    if points.ndim != 2 or points.shape[1] != at.values[f"{name}_dimension"]:
        raise ValueError(f"queries have not {at.values[f'{name}_dimension']} components")
    rows = store.parts(f"{name}_rows", at=at)
    clusters = sorted(store.read(f"{name}_pivots", at).collect(), key=lambda r: r.cluster)  # 1,024 at most
    if rows is None or not clusters:
        return spark.createDataFrame([], "query int, key bigint, distance double, rank int")
    pivots = np.array([c.pivot for c in clusters])
    low, high, n = (np.array([c[f] for c in clusters]) for f in ("low", "high", "n"))
    away = np.sqrt(((points[:, None, :] - pivots[None]) ** 2).sum(axis=2))
    # first: the nearest clusters that hold k vectors together
    first: dict[int, list[tuple[int, float, float]]] = {}
    for q in range(len(points)):
        held = 0
        for c in np.argsort(away[q], kind="stable").tolist():
            first.setdefault(clusters[c].cluster, []).append((q, float(low[c]), float(high[c])))
            held += n[c]
            if held >= k:
                break
    best = W.partitionBy("query").orderBy("distance", "key")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    limits = {r.query: r.d for r in ranked(_scan(rows, points, first, k)).groupBy("query").agg(F.max("distance").alias("d"), F.count("*").alias("n")).filter(F.col("n") >= k).collect()}
    wanted: dict[int, list[tuple[int, float, float]]] = {}
    for q in range(len(points)):
        most = limits.get(q, np.inf)
        lo, hi = away[q] - most, away[q] + most
        slack = SLACK * (1 + away[q] + high)
        for c in np.flatnonzero((hi + slack >= low) & (lo - slack <= high)).tolist():
            wanted.setdefault(clusters[c].cluster, []).append((q, float(lo[c] - slack[c]), float(min(hi[c] + slack[c], 1e300))))
    if report is not None:
        ranges = spark.createDataFrame([(c, q, lo, hi) for c, w in wanted.items() for q, lo, hi in w], "c int, q int, lo double, hi double")
        read = rows.select("cluster", "radius").join(F.broadcast(ranges), (F.col("cluster") == F.col("c")) & F.col("radius").between(F.col("lo"), F.col("hi"))).count()
        report |= {"vectors": int(n.sum()), "compared": read, "clusters": sum(len(w) for w in wanted.values()), "of": len(points) * len(clusters)}
    return ranked(_scan(rows, points, wanted, k)).select("query", "key", "distance", "rank")
