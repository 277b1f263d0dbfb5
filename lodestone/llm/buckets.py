"""Work on groups of rows that share a bucket, without a group ever having to fit one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.llm.common import cut, give_back


def split_large(rows: DataFrame, bucket: str, member: str, limit: int) -> DataFrame:
    """Adds `part_a`, `part_b` and `side` so that no (bucket, part_a, part_b) holds much over 2 * `limit` rows.

    A bucket of more than `limit` rows is dealt into g parts by a hash of `member`,
    and its rows go to each of the g pairs of parts that have their part. Every two
    rows of the bucket still meet: those of different parts in one place (`side` 0
    and 1), those of one part in the pair of that part with itself (`side` 2).
    """
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > limit)
    sizes = cut(sizes.select(bucket, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts")))
    whole = F.struct(F.lit(0).alias("part_a"), F.lit(0).alias("part_b"), F.lit(2).alias("side"))
    if sizes.isEmpty():
        return rows.select("*", whole.alias("_p")).select(*rows.columns, "_p.*")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_parts") - 1),
        lambda other: F.struct(
            F.least(F.col("_own"), other).alias("part_a"),
            F.greatest(F.col("_own"), other).alias("part_b"),
            F.when(F.col("_own") == other, 2).when(F.col("_own") < other, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = rows.join(sizes, bucket, "left").withColumn("_own", own)
    spread = F.explode(F.when(F.col("_parts").isNull(), F.array(whole)).otherwise(pairs))
    return dealt.select(*rows.columns, spread.alias("_p")).select(*rows.columns, "_p.*")


def map_groups(
    rows: DataFrame,
    keys: list[str],
    schema: StructType,
    work: Callable[[pa.Table, np.ndarray], list[pa.RecordBatch]],
    at_once: int = 200_000,
) -> DataFrame:
    """Bring the rows of each key together and hand tasks many whole groups at a time.

    `work(table, starts)` gets rows sorted by key and the index at which each group
    starts. Rows stream through; only the group that a batch ends in waits for the next.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0

        def whole(last: bool) -> tuple[pa.Table, pa.Table, np.ndarray]:
            table = pa.Table.from_batches(waiting).combine_chunks()
            starts = group_starts([table.column(k).to_numpy() for k in keys])
            end = table.num_rows if last else int(starts[-1])
            return table.slice(0, end), table.slice(end), starts[starts < end]

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            held += batch.num_rows
            if held < at_once:
                continue
            done, rest, starts = whole(False)
            if done.num_rows:
                yield from work(done, starts)
            waiting, held = rest.to_batches(), 0
        if waiting:
            done, _, starts = whole(True)
            yield from work(done, starts)
        waiting = []
        give_back()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def group_starts(keys: list[np.ndarray]) -> np.ndarray:
    """Where a new key begins in sorted columns."""
    change = np.zeros(len(keys[0]), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)
