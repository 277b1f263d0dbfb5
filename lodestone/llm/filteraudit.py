"""How filters overlap: what each removes in every order they can be applied in.

Each document has a mask of the filters it fails. Documents are counted by part and mask,
which combines before the shuffle, and of the counts alone a Gray-code walk visits all
subsets of the filters: it toggles one filter at a time, keeps for each mask the number of
active filters that it fails, and moves a mask's documents out of the running survivors
when that number leaves zero and back when it returns. The survivors of the 32 subsets are
stored; any step of any order is the difference of two of them, so no order reads a
document.

Defined results: a null text is the empty one and a null part the empty string. A document
is a copy if a smaller id has the same text; rows of equal id are no copies of each other,
a null id is no copy, and nothing is a copy of it. A document counts as good or toxic if
any label row of its id says so. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import math
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bound, cut, map_batches, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("n", "good", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails filters A to D; `text` is never null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    sizes = bound(words, lambda w: F.struct(F.size(w).cast("long").alias("all"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    few = bound(sizes, lambda s: F.struct((s["all"] < 200).alias("a"), (100 * s["distinct"] < 50 * s["all"]).alias("b")))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {"AB": few, "C": 100 * capitals > 3 * F.char_length(text), "D": text.rlike("[#$%&*|]")}


def masks(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(_id, part, mask): bit 0 to 4 for the filters A to E that a document fails."""
    found = text_filters(F.col("_t"))
    bit = lambda c, n: F.when(c, 1 << n).otherwise(0)
    read = df.select(F.col(key).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("_t"))
    read = read.select("_id", "part", F.unhex(F.sha2("_t", 256)).alias("_digest"), found["AB"].alias("_few"), bit(found["C"], 2).alias("_c"), bit(found["D"], 3).alias("_d"))
    narrow = cut(read.select("_id", "part", "_digest", (bit(F.col("_few.a"), 0) + bit(F.col("_few.b"), 1) + F.col("_c") + F.col("_d")).alias("mask")))
    # texts that stand once have no copy; the rest is small and is written, so that Spark can split a text of very many copies
    first = cut(narrow.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    return narrow.join(first, "_digest", "left").select("_id", "part", (F.col("mask") + bit(copy, 4)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents counted by their mask."""
    says = labels.groupBy(F.col(key).alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    known = masked.join(says.filter("_id IS NOT NULL"), "_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return known.groupBy("part", "mask").agg(F.count("*").alias("n"), count("_good").alias("good"), count("_toxic").alias("toxic"))


def survivors(counts: np.ndarray) -> np.ndarray:
    """[subsets, ...]: of counts [..., masks] what every subset of the filters leaves, by a Gray-code walk."""
    of = np.arange(counts.shape[-1])
    running = counts.sum(axis=-1)
    states = np.zeros((len(of), *running.shape), dtype=np.int64)
    states[0] = running
    failures, active = np.zeros(len(of), dtype=np.int64), 0
    for step in range(1, len(of)):
        toggled = step & -step  # neighbours in the Gray code differ in the lowest bit set in the step
        failing = of & toggled != 0
        if active & toggled:
            failures[failing] -= 1
            running = running + counts[..., failing & (failures == 0)].sum(axis=-1)
        else:
            running = running - counts[..., failing & (failures == 0)].sum(axis=-1)
            failures[failing] += 1
        active ^= toggled
        states[active] = running
    return states


def steps(counts: np.ndarray, letters: str = "ABCDE") -> dict[str, np.ndarray | list[str]]:
    """Columns of all steps of all orders for counts [3, parts, masks], part by part."""
    k, states = len(letters), survivors(counts)  # [subsets, 3, parts]
    orders = ["".join(p) for p in permutations(letters)]
    bits = np.array([[1 << letters.index(c) for c in o] for o in orders])  # [orders, steps]
    after = np.cumsum(bits, axis=1)
    before, everything = after - bits, (1 << k) - 1
    kept, gone = states[after], states[before] - states[after]  # [orders, steps, 3, parts]
    # what a filter removes after a subset, in all the orders that begin with it
    shapley = np.zeros((k, counts.shape[1]), dtype=np.int64)
    for f in range(k):
        for s in range(1 << k):
            if not s >> f & 1:
                size = s.bit_count()
                times = math.factorial(size) * math.factorial(k - 1 - size)
                shapley[f] += times * (states[s, 0] - states[s | 1 << f, 0])
    place = np.log2(bits).round().astype(int)
    alone = states[0] - states[1 << np.arange(k)]  # [filters, 3, parts]: all that fail each
    unique = states[everything ^ (1 << np.arange(k))] - states[everything]
    flat = lambda x: np.moveaxis(x, -1, 0).ravel()  # noqa: E731  parts outermost
    return {
        "filter_order": np.tile(np.repeat(orders, k), counts.shape[1]),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * counts.shape[1]),
        "kept": flat(kept[:, :, 0]), "removed": flat(gone[:, :, 0]),
        "redundant": flat(alone[place, 0] - gone[:, :, 0]), "unique_fails": flat(unique[place, 0]),
        "good_lost": flat(gone[:, :, 1]), "toxic_lost": flat(gone[:, :, 2]), "shapley": flat(shapley[place]),
    }


def interactions(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of `cells`."""
    size = 1 << len(letters)
    # a part has at most one row for each mask
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        parts, lists = batch.column(0), batch.column(1)
        counts = np.zeros((len(COUNTS), len(parts), size), dtype=np.int64)
        of, flat = np.repeat(np.arange(len(parts)), np.diff(lists.offsets.to_numpy())), lists.flatten()
        mask = flat.field("mask").to_numpy()
        for i, name in enumerate(COUNTS):
            counts[i, of, mask] = flat.field(name).to_numpy()
        found = steps(counts, letters)
        each = len(found["step"]) // len(parts)
        return {"part": parts.take(pa.array(np.repeat(np.arange(len(parts)), each))), **found}

    longs = ", ".join(f"{c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return map_batches(packed, f"part string, filter_order string, step int, {longs}", rows, rows=64)


def audit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """All orders of the filters A to E over `df`, part by part; `labels` (key, quality, toxic) says what is lost."""
    return interactions(cells(masks(df, key, text, part), labels, key))
