"""A stored inverted index in document blocks, whose highest impacts let a search skip most of it.

Documents are cut into blocks of `BLOCK`. A task reads the documents of a block, folds their
tokens in place and makes one row for each term of the block, so tokens are never shuffled:
(term, block, n, cf, frontier, docs, positions). `docs` has slot, key, tf and length of the
documents that hold the term, `frontier` the pairs of tf and length that no other document
of the row beats in both, so the highest score of the row is known for any statistics of
the corpus. Rows lie in folders by a hash of their term and are sorted by term and block: a
search opens the folders of its terms and reads `docs` of the blocks it needs, `positions`
only for phrases. Rows go to their folders packed: all that a task has for a folder from some
thousand documents is one compressed Arrow table, which is opened where it is sorted and written.

`top` finds the k best documents in three passes. The first reads the narrow columns and
adds up what each block can reach; the second scores the most promising blocks and so
learns what the k-th document has at least; the third scores the blocks that can reach that.

An index is a group of tables of a store (`<name>_postings`, `<name>_lengths` with the place
of each document, `<name>_gone` with the places that no longer count) and its totals among
the store's values, so it changes in one commit with other tables. Documents of equal keys
within one write are kept apart. A task must give the same rows when it is tried again, so
documents are put in the order of their keys where they are dealt anew.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.operators.retrieval import bm25_term, idf, phrases
from lodestone.sources.publish import _Files
from lodestone.sources.store import Store, Transaction

BLOCK = 64
#: Pairs of tf and length kept for a row; further ones are covered by a pair that is better than both.
FRONTIER = 6
#: Bytes of rows that a task packs at once, and of packed rows that are sorted by one task: opened they are some fifteen times as large.
PACK, SORTED = 32 << 20, 16 << 20
#: Letters and digits of ASCII, folded, and all bytes above stay; the rest parts words.
_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 bytes."""
    return text.translate(_FOLD).split()


def trigrams_of(text: bytes) -> list[bytes]:
    low = text.decode().lower()
    return [low[i : i + 3].encode() for i in range(len(low) - 2)]


KINDS = {"words": words_of, "trigrams": trigrams_of}


def _bucket(term: Column, buckets: int, hashed: str) -> Column:
    """The folder of a term; indexes from before rows were packed go by `xxhash64`, which tasks in Python lack."""
    return F.pmod(F.crc32(term) if hashed == "crc32" else F.xxhash64(term), F.lit(buckets)).cast("int")


def _hash(values: dict, name: str) -> str:
    return values.get(f"{name}_hash", "xxhash64")


def _shapes(key: str) -> tuple[str, str]:
    docs = f"array<struct<slot:int,key:{key},tf:int,length:int>>"
    return (
        f"term string, block bigint, n int, cf int, frontier array<struct<tf:int,length:int>>, docs {docs}, positions array<array<int>>",
        f"key {key}, block bigint, slot int, length int",
    )


def _frontier(row: np.ndarray, tf: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tf, length) of pairs such that every document has at most the tf and at least the length of one pair of its row.

    `row` numbers the rows from 0 on. A pair stays if it is shorter than all of its row that
    have its tf or more; of a row with too many the last takes the place of those behind it.
    """
    order = np.lexsort((length, -tf, row))
    row, tf, length = row[order], tf[order], length[order]
    # rows lie one below the other, so one running minimum serves them all
    level = length - row * (int(length.max(initial=0)) + 1)
    keep = np.ones(len(row), dtype=bool)
    keep[1:] = level[1:] < np.minimum.accumulate(level)[:-1]
    row, tf, length = row[keep], tf[keep], length[keep]
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    count = np.diff(np.append(begin, len(row)))
    place = np.arange(len(row)) - np.repeat(begin, count)
    many = count > FRONTIER
    length[begin[many] + FRONTIER - 1] = length[(begin + count - 1)[many]]
    keep = place < FRONTIER
    return row[keep], tf[keep], length[keep]


def _postings_of(keys: pa.Array, tokens: list[list[bytes]], block: int) -> dict[str, object]:
    """Columns of the posting rows of one block."""
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for ws in tokens for w in ws), dtype=np.int64)
    sizes = np.array([len(ws) for ws in tokens], dtype=np.int64)
    slot = np.repeat(np.arange(len(tokens)), sizes)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(codes, kind="stable")  # so documents and places stay in order
    codes, slot, at = codes[order], slot[order], at[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (slot[1:] != slot[:-1])
    first = np.flatnonzero(new)  # of each term and document
    tf = np.diff(np.append(first, len(codes)))
    term, doc = codes[first], slot[first]  # terms are numbered as they come: a term's number is its row
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    n = np.diff(np.append(begin, len(term)))
    int_ = lambda x: pa.array(x.astype(np.int32))
    lists = int_(np.append(begin, len(term)))
    row, most, least = _frontier(term, tf, sizes[doc])
    frontier = pa.StructArray.from_arrays([int_(most), int_(least)], names=["tf", "length"])
    docs = pa.StructArray.from_arrays([int_(doc), keys.take(pa.array(doc)), int_(tf), int_(sizes[doc])], names=["slot", "key", "tf", "length"])
    places = pa.ListArray.from_arrays(int_(np.append(first, len(codes))), int_(at))
    return {
        "term": pa.array(list(numbers), type=pa.binary()).cast(pa.string()), "block": np.full(len(begin), block), "n": int_(n),
        "cf": int_(np.add.reduceat(tf, begin)) if len(begin) else int_(n),
        "frontier": pa.ListArray.from_arrays(int_(np.searchsorted(row, np.arange(len(begin) + 1))), frontier),
        "docs": pa.ListArray.from_arrays(lists, docs), "positions": pa.ListArray.from_arrays(lists, places),
    }


def _folded(schema: str, kind: str, segment: int, lengths: bool):
    """A function from batches of (key, text) to posting rows of their blocks, or to the place of each document with its length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    split, arrow = KINDS[kind], to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        block = segment << 44 | TaskContext.get().partitionId() << 22
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                tokens = [split(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                if lengths:
                    out = {"key": part.column(0), "block": np.full(len(tokens), block), "slot": np.arange(len(tokens), dtype=np.int32), "length": np.array([len(t) for t in tokens], dtype=np.int32)}
                else:
                    out = _postings_of(part.column(0), tokens, block)
                arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(n).type) for n, v in out.items()]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
                block += 1

    return run


def _blocks(df: DataFrame, schema: str, kind: str, segment: int, lengths: bool) -> DataFrame:
    """Posting rows of `df` (key, text), or the place of each document with its length."""
    ship(df.sparkSession)
    return df.mapInArrow(_folded(schema, kind, segment, lengths), schema)


def _packed(rows: pa.Table, buckets: int) -> pa.RecordBatch:
    """(_bucket, rows): posting rows by the folder of their term, those of a folder as one Arrow stream."""
    bucket = np.fromiter((zlib.crc32(t) % buckets for t in rows.column("term").cast(pa.binary()).to_pylist()), dtype=np.int32, count=rows.num_rows)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.combine_chunks().take(pa.array(order)), bucket[order]
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    streams = []
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(rows.slice(lo, hi - lo))
        streams.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(streams, type=pa.binary())], names=["_bucket", "rows"])


def _pack(df: DataFrame, schema: str, kind: str, segment: int, buckets: int) -> DataFrame:
    """The posting rows of `df` (key, text), packed."""
    fold = _folded(schema, kind, segment, lengths=False)
    ship(df.sparkSession)

    def run(batches):
        held, size = [], 0
        for rows in fold(batches):
            held.append(rows)
            size += rows.nbytes
            if size >= PACK:
                yield _packed(pa.Table.from_batches(held), buckets)
                held, size = [], 0
        if size:
            yield _packed(pa.Table.from_batches(held), buckets)

    return df.mapInArrow(run, "_bucket int, rows binary")


def _opened(packed: DataFrame, schema: str) -> DataFrame:
    """The rows of `_pack` with their `_bucket`."""

    def run(batches):
        for batch in batches:
            for bucket, stream in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for rows in pa.ipc.open_stream(stream.as_buffer()):
                    for start in range(0, rows.num_rows, 10_000):
                        part = rows.slice(start, 10_000)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, bucket, dtype=np.int32))], names=[*part.schema.names, "_bucket"])

    return packed.mapInArrow(run, f"{schema}, _bucket int")


def _dealt(df: DataFrame) -> DataFrame:
    """Documents on all cores, in an order that is the same each time; a table of many files is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, "key").sortWithinPartitions("key")


def _buckets_for(df: DataFrame, store: Store) -> int:
    """Folders such that each has some 64 MB of what is written first, 4 to 4,096."""
    # the input may lie in another file system than the store
    total = sum(_Files(store.spark, f).fs.getFileStatus(store.files.at(f)).getLen() for f in df.inputFiles())
    return int(min(4096, max(4, 2 ** np.ceil(np.log2(max(1, total / 64e6))))))


def add(tx: Transaction, df: DataFrame, key: str, text: Column, name: str = "index", gone: DataFrame | None = None, kind: str = "words", buckets: int | None = None) -> None:
    """Put the documents of `df` into the index, in place of what it has of their keys and of those in `gone`; seen when `tx` commits.

    `df` is read twice: it should be a stored table, or cheap.
    """
    docs = df.select(F.col(key).alias("key"), text.alias("text"))
    shape = docs.schema["key"].dataType.simpleString()
    postings, lengths = _shapes(shape)
    fresh = f"{name}_lengths" not in tx.tables
    if fresh:
        tx.create(f"{name}_postings", StructType.fromDDL(postings), ["term"], buckets or _buckets_for(df, tx.store))
        tx.create(f"{name}_lengths", StructType.fromDDL(lengths), ["key"])
        tx.create(f"{name}_gone", StructType.fromDDL("block bigint, slot int"), ["block"], 1)
        tx.values |= {f"{name}_kind": kind, f"{name}_hash": "crc32"}
    else:
        replaced = docs.select("key") if gone is None else docs.select("key").unionByName(gone.select(F.col(gone.columns[0]).alias("key")))
        remove(tx, replaced, name)
    dealt = _dealt(docs)
    kind = tx.values[f"{name}_kind"]
    folders, hashed = tx.tables[f"{name}_postings"]["buckets"], _hash(tx.values, name)
    if hashed == "crc32":
        packed = _pack(dealt, postings, kind, tx.seq, folders)
        tx.append_packed(f"{name}_postings", packed, lambda df: _opened(df, postings), ["term", "block"], SORTED)
    else:
        tx.append(f"{name}_postings", _blocks(dealt, postings, kind, tx.seq, lengths=False), _bucket(F.col("term"), folders, hashed), ["term", "block"])
    before = len(tx.tables[f"{name}_lengths"]["rows"])
    tx.append(f"{name}_lengths", _blocks(dealt, lengths, kind, tx.seq, lengths=True))
    added = tx.tables[f"{name}_lengths"]["rows"][before:]
    n = words = 0
    if added:
        written = tx.store.spark.read.parquet(*(tx.store._part(f"{name}_lengths", p["part"]) for p in added))
        n, words = written.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    _count(tx, name, n, words)


def _count(tx: Transaction, name: str, n: int, words: int) -> None:
    old = tx.values.get(f"{name}_totals", [0, 0])
    tx.values[f"{name}_totals"] = [old[0] + n, old[1] + words]


def remove(tx: Transaction, keys: DataFrame, name: str = "index") -> None:
    """Take documents (one column of keys) out of the index; seen when `tx` commits."""
    named = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    places = tx.read(f"{name}_lengths")
    found = places.join(named, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    n, words = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n:
        tx.append(f"{name}_gone", found.select("block", "slot"))
        tx.delete(f"{name}_lengths", found.select("key"))
    _count(tx, name, -n, -words)


def write(df: DataFrame, path: str, key: str, text: Column, gone: DataFrame | None = None, kind: str = "words", buckets: int | None = None) -> None:
    """`add` as a commit of its own to the store at `path`."""
    Store(df.sparkSession, path).transact(lambda tx: add(tx, df, key, text, gone=gone, kind=kind, buckets=buckets))


def delete(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """`remove` as a commit of its own."""
    Store(spark, path).transact(lambda tx: remove(tx, keys))


def compact(spark: SparkSession, path: str, name: str = "index") -> None:
    """Write the index anew without the documents that no longer count, as one part; no text is read."""

    def work(tx: Transaction) -> None:
        shape = tx.read(f"{name}_lengths").schema["key"].dataType.simpleString()
        rows = _Reader(spark, path, name, tx.base).rows(None)
        rows = rows.select("term", "block", F.size("docs").alias("n"), F.expr("aggregate(docs, 0, (a, d) -> a + d.tf)").alias("cf"), "frontier", "docs", "positions").filter("n > 0")
        known = tx.tables[f"{name}_postings"]
        rows = rows.select(*StructType.fromDDL(_shapes(shape)[0]).names)
        known["rows"] = []
        tx.append(f"{name}_postings", rows, _bucket(F.col("term"), known["buckets"], _hash(tx.values, name)), ["term", "block"])
        tx.clear(f"{name}_gone")

    Store(spark, path).transact(work)


class _Reader:
    """One version of an index."""

    def __init__(self, spark: SparkSession, path: str, name: str = "index", at=None):
        self.spark, self.store, self.name = spark, Store(spark, path), name
        self.at = at or self.store.version()
        if f"{name}_postings" not in self.at.tables:
            raise LookupError(f"there is no index {name} at {path}")
        self.n, self.words = self.at.values[f"{name}_totals"]
        self.buckets = self.at.tables[f"{name}_postings"]["buckets"]
        has_gone = self.at.tables[f"{name}_gone"]["rows"]
        # by block; a compaction ends them
        self.gone = self.store.read(f"{name}_gone", self.at).groupBy("block").agg(F.collect_set("slot").alias("_gone")) if has_gone else None
        self.key = self.store.read(f"{name}_lengths", self.at).schema["key"].dataType

    @property
    def mean(self) -> float:
        return self.words / self.n if self.n else 0.0

    def stored(self, terms: list[str] | None) -> DataFrame:
        rows = self.store.parts(f"{self.name}_postings", at=self.at)
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromDDL(_shapes(self.key.simpleString())[0]))
        if terms is None:
            return rows
        places = self.spark.range(1).select(*(_bucket(F.lit(t), self.buckets, _hash(self.at.values, self.name)).alias(f"b{i}") for i, t in enumerate(terms))).first()
        return rows.filter(F.col("_bucket").isin(sorted(set(places))) & F.col("term").isin(terms))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows that have `_gone`, without the documents named there."""
        here = lambda d: ~F.array_contains("_gone", d["slot"])
        out = rows
        if "positions" in rows.columns:
            both = F.filter(F.arrays_zip("docs", "positions"), lambda x: here(x["docs"]))
            out = out.withColumn("_both", F.when(F.col("_gone").isNull(), F.arrays_zip("docs", "positions")).otherwise(both))
            return out.withColumns({"docs": F.col("_both.docs"), "positions": F.col("_both.positions")}).drop("_both", "_gone")
        return out.withColumn("docs", F.when(F.col("_gone").isNull(), F.col("docs")).otherwise(F.filter("docs", here))).drop("_gone")

    def rows(self, terms: list[str] | None, places: bool = True) -> DataFrame:
        """(term, block, frontier, docs, positions) of the documents that count."""
        found = self.stored(terms).select("term", "block", "frontier", "docs", *(["positions"] if places else []))
        return found if self.gone is None else self._alive(found.join(self.gone, "block", "left"))

    def heads(self, terms: list[str] | None) -> DataFrame:
        """(term, block, n, cf, frontier): the narrow columns; `docs` only of blocks with documents that no longer count."""
        found = self.stored(terms)
        narrow = ["term", "block", "n", "cf", "frontier"]
        if self.gone is None:
            return found.select(*narrow)
        dirty = self._alive(found.select("term", "block", "frontier", "docs").join(self.gone, "block"))
        dirty = dirty.select("term", "block", F.size("docs").alias("n"), F.expr("aggregate(docs, 0, (a, d) -> a + d.tf)").alias("cf"), "frontier")
        return found.select(*narrow).join(self.gone, "block", "left_anti").unionByName(dirty.filter("n > 0"))


def frequencies(spark: SparkSession, path: str, name: str = "index") -> DataFrame:
    """(term, df, cf) of all terms, from the narrow columns."""
    return _Reader(spark, path, name).heads(None).groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def terms(spark: SparkSession, path: str, wanted: list[str] | None = None, name: str = "index") -> DataFrame:
    """(term, key, length, positions) of the index; of the `wanted` terms their folders only."""
    rows = _Reader(spark, path, name).rows(wanted)
    flat = rows.select("term", F.explode(F.arrays_zip("docs", "positions")).alias("x"))
    return flat.select("term", F.col("x.docs.key").alias("key"), F.col("x.docs.length").alias("length"), F.col("x.positions").alias("positions"))


def _back(places: Column, steps: int) -> Column:
    return F.transform(places, lambda x: x - steps)


class _Query:
    """A query's phrases with their tokens, and the documents of posting rows that hold them."""

    def __init__(self, query: list[list[str]] | str):
        self.given = phrases(query) if isinstance(query, str) else query
        self.wanted = list(dict.fromkeys(map(tuple, self.given)))
        self.tokens = sorted({t for p in self.wanted for t in p})
        self.number = {t: i for i, t in enumerate(self.tokens)}
        self.single = all(len(p) == 1 for p in self.wanted)
        self.weight = [sum(tuple(w) == p for w in self.given) for p in self.wanted]

    def counted(self, rows: DataFrame) -> DataFrame:
        """(block, key, slot, _length, _tf0, _tf1, ...): how often each phrase stands in each document of the rows."""
        x = F.explode("docs") if self.single else F.explode(F.arrays_zip("docs", "positions"))
        flat = rows.select("term", "block", x.alias("x"))
        doc = F.col("x") if self.single else F.col("x.docs")
        value = doc["tf"] if self.single else F.col("x.positions")
        flat = flat.select("term", "block", doc["slot"].alias("slot"), doc["key"].alias("key"), doc["length"].alias("_length"), value.alias("_v"))
        own = [F.max(F.when(F.col("term") == t, F.col("_v"))).alias(f"_p{i}") for i, t in enumerate(self.tokens)]
        side = flat.groupBy("block", "slot").agg(F.first("key").alias("key"), F.first("_length").alias("_length"), *own)

        def times(p: tuple[str, ...]) -> Column:
            first = F.col(f"_p{self.number[p[0]]}")
            if self.single:
                return first
            for step, token in enumerate(p[1:], 1):
                first = F.array_intersect(first, _back(F.col(f"_p{self.number[token]}"), step))
            return F.size(first)

        return side.select("block", "slot", "key", "_length", *(F.greatest(F.coalesce(times(p), F.lit(0)), F.lit(0)).alias(f"_tf{i}") for i, p in enumerate(self.wanted)))

    def match(self, all_terms: bool, has=lambda i: F.col(f"_tf{i}") > 0) -> Column:
        out = has(0)
        for i in range(1, len(self.wanted)):
            out = out & has(i) if all_terms else out | has(i)
        return out

    def score(self, weights: list[Column], mean: Column) -> Column:
        out = F.lit(0.0)
        for i, w in enumerate(weights):
            out = out + bm25_term(w * self.weight[i], F.col(f"_tf{i}"), F.col("_length"), mean)
        return out


def search(spark: SparkSession, path: str, query: list[list[str]] | str, all_terms: bool = True, name: str = "index") -> DataFrame:
    """(key, score) by BM25 of all documents that hold all phrases of `query`, or any; a phrase given twice counts twice.

    `query` is free text or a list of phrases of tokens. Without a token nothing is found.
    """
    asked, reader = _Query(query), _Reader(spark, path, name)
    if not asked.tokens:
        return spark.createDataFrame([], StructType().add("key", reader.key).add("score", "double"))
    counted = asked.counted(reader.rows(asked.tokens, places=not asked.single))
    if asked.single:
        stats = reader.heads(asked.tokens).agg(*(F.coalesce(F.sum(F.when(F.col("term") == p[0], F.col("n"))), F.lit(0)).alias(f"_df{i}") for i, p in enumerate(asked.wanted)))
    else:
        stats = counted.agg(*(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(asked.wanted))))
    weights = [idf(F.lit(float(reader.n)), F.col(f"_df{i}")) for i in range(len(asked.wanted))]
    # the statistics are one row
    return counted.filter(asked.match(all_terms)).join(F.broadcast(stats)).select("key", asked.score(weights, F.lit(reader.mean)).alias("score"))


def top(spark: SparkSession, path: str, query: list[list[str]] | str, k: int, all_terms: bool = True, name: str = "index", report: dict | None = None, first: int = 16) -> DataFrame:
    """(key, score) of the k best of `search`, best first and then by key, without scoring blocks that cannot reach them.

    `report` takes the numbers of `postings` of the terms and of those `decoded`. Queries
    with phrases of several tokens are searched as a whole, since only positions tell how
    often a phrase stands in a block.
    """
    asked, reader = _Query(query), _Reader(spark, path, name)
    best = lambda df: df.orderBy(F.desc("score"), "key").limit(k)
    if not asked.tokens or not asked.single:
        return best(search(spark, path, query, all_terms, name))
    heads = reader.heads(asked.tokens)
    held = heads.groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each token of the query
    df = {r.term: r.n for r in held}
    weights = [idf(F.lit(float(reader.n)), F.lit(df.get(p[0], 0))) for p in asked.wanted]
    mean = F.lit(reader.mean)
    # what a block can reach: the best pair of each row
    reach = F.lit(None).cast("double")
    for i, p in enumerate(asked.wanted):
        weight = weights[i] * asked.weight[i]
        most = F.array_max(F.transform("frontier", lambda f: bm25_term(weight, f["tf"], f["length"], mean)))  # noqa: B023
        reach = F.when(F.col("term") == p[0], most).otherwise(reach)
    blocks = heads.select("block", "n", reach.alias("reach")).groupBy("block").agg(F.sum("reach").alias("reach"), F.count("*").alias("terms"), F.sum("n").alias("n"))
    if all_terms:
        blocks = blocks.filter(F.col("terms") == len(asked.wanted))
    rows = reader.rows(asked.tokens, places=False)
    scored = lambda rows: asked.counted(rows).filter(asked.match(all_terms)).select("block", "key", asked.score(weights, mean).alias("score"))
    start = [r.block for r in blocks.orderBy(F.desc("reach"), "block").limit(max(first, -(-k // BLOCK) * 2)).collect()]
    one = sorted((-r.score, r.key) for r in best(scored(rows.filter(F.col("block").isin(start)))).collect())
    least = -one[k - 1][0] * (1 - 1e-9) if len(one) == k else None
    good = blocks if least is None else blocks.filter(F.col("reach") >= least)
    if report is not None:
        report |= {"postings": sum(df.values()), "decoded": good.unionByName(blocks.filter(F.col("block").isin(start))).distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "blocks": good.count()}
    return best(scored(rows.join(good.select("block"), "block", "left_semi")).select("key", "score"))


def phrase_search(spark: SparkSession, path: str, query: str, limit: int = 20, name: str = "index") -> DataFrame:
    """(key, score) of texts that hold `query` in any case, by BM25 over a trigram index; queries of three characters and more.

    The grams of the query are rows of an index by `trigrams`; blocks without its rarest gram
    are not read, and places tell where the grams follow each other. A query counts as often
    as it stands without overlap in the text.
    """
    reader = _Reader(spark, path, name)
    grams = [g.decode() for g in trigrams_of(query.encode())]
    if not grams:
        raise ValueError("a phrase has three characters at least")
    heads = {r.term: r.n for r in reader.heads(sorted(set(grams))).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    nothing = spark.createDataFrame([], StructType().add("key", reader.key).add("score", "double"))
    if len(heads) < len(set(grams)):
        return nothing
    distinct = sorted(set(grams), key=lambda g: (heads[g], g))
    rows = reader.rows(distinct)
    rare = rows.filter(F.col("term") == distinct[0]).select("block")
    rows = rows.join(rare, "block", "left_semi")
    flat = rows.select("term", "block", F.explode(F.arrays_zip("docs", "positions")).alias("x"))
    flat = flat.select("term", "block", F.col("x.docs.slot").alias("slot"), F.col("x.docs.key").alias("key"), F.col("x.docs.length").alias("_length"), F.col("x.positions").alias("_at"))
    own = [F.max(F.when(F.col("term") == g, F.col("_at"))).alias(f"_p{i}") for i, g in enumerate(distinct)]
    side = flat.groupBy("block", "slot").agg(F.first("key").alias("key"), F.first("_length").alias("_length"), *own)
    number = {g: i for i, g in enumerate(distinct)}
    begins = F.col(f"_p{number[grams[0]]}")
    for step, g in enumerate(grams[1:], 1):
        begins = F.array_intersect(begins, _back(F.col(f"_p{number[g]}"), step))
    # places from the left, each at least a query's length behind the one before
    apart = F.aggregate(F.array_sort(begins), F.struct(F.lit(0).alias("n"), F.lit(-(1 << 30)).alias("last")), lambda a, x: F.when(x >= a["last"] + len(query.lower()), F.struct((a["n"] + 1).alias("n"), x.alias("last"))).otherwise(a))
    counted = side.select("key", "_length", apart["n"].alias("_tf")).filter("_tf > 0")
    stats = counted.agg(F.count("*").alias("_df"))
    weight = idf(F.lit(float(reader.n)), F.col("_df"))
    scored = counted.join(F.broadcast(stats)).select("key", bm25_term(weight, F.col("_tf"), F.col("_length"), F.lit(reader.mean)).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(limit)
