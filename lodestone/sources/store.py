"""Tables of one folder that change together, and changes that are merged when they are read.

A store has data and versions. A part is a folder of Parquet files that is written once:
rows of a table, or keys of rows that no longer count. A version is a small file that names
the parts of every table. Writers put new parts beside the old ones, where no reader looks,
and then create the file of the next version; it exists with all of its content or not at
all, and only one of two writers can create it. So a commit covers any number of tables, a
writer that breaks off leaves nothing behind but parts that `vacuum` clears away, and one
that lost a race learns it and starts again from the newer version.

Rows lie in folders by a hash of their key. An update writes the new rows and the keys they
replace, whatever the size of the table: a row counts if no later part names its key.
Readers compare keys only in the buckets that such keys fall into, and `compact` rewrites
those buckets alone. Columns may be added with a default for the rows that are older.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from lodestone.sources.publish import _Files

BUCKETS = 16


class Conflict(Exception):
    """Another writer has committed since the transaction began."""


@dataclass
class Version:
    """What is live: tables by name, values by name."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)
    values: dict[str, object] = field(default_factory=dict)


def _create(files: _Files, path: str, text: str) -> bool:
    """Create a file with all of its content, or give False if it exists."""
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    out = files.fs.create(files.at(temporary), True)
    out.write(bytearray(text.encode()))
    out.close()
    if files.fs.getScheme() != "file":
        done = files.rename(temporary, path)  # fails where the name is taken
        if not done:
            files.delete(temporary)
        return done
    # a local rename would replace the file, a link does not
    name = lambda p: files.at(p).toUri().getPath()
    try:
        os.link(name(temporary), name(path))
        return True
    except FileExistsError:
        return False
    finally:
        files.delete(temporary)


def _shape(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))


class Store:
    """A folder of versioned tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = _Files(spark, folder)

    def version(self, number: int | None = None) -> Version:
        """The newest version, or that of a number."""
        if number is None:
            number = max((int(p.rsplit("/", 1)[1][1:-5]) for p in self.files.like(f"{self.folder}/versions/v*.json")), default=0)
        if number == 0:
            return Version()
        stream = self.files.fs.open(self.files.at(self._name(number)))
        try:
            found = json.loads(self.files.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, found["tables"], found["values"])

    def _name(self, number: int) -> str:
        return f"{self.folder}/versions/v{number:012d}.json"

    def _part(self, table: str, part: str) -> str:
        return f"{self.folder}/data/{table}/part={part}"

    def has(self, table: str) -> bool:
        return table in self.version().tables

    def parts(self, table: str, kind: str = "rows", at: Version | None = None) -> DataFrame | None:
        """Rows of the live parts of a table with `part`, `_bucket` and `_seq`, those that no longer count included; None without any."""
        known = (at or self.version()).tables.get(table, {})
        live = known.get(kind, [])
        if not live:
            return None
        shape = _shape(known["columns" if kind == "rows" else "keys"])
        shape = shape.add("part", StringType()).add("_bucket", IntegerType())
        read = self.spark.read.schema(shape).option("basePath", f"{self.folder}/data/{table}")
        df = read.parquet(*(self._part(table, p["part"]) for p in live))
        if len(live) == 1:
            df = df.withColumn("_seq", F.lit(live[0]["seq"]))
        else:
            df = df.withColumn("_seq", F.create_map(*(F.lit(x) for p in live for x in (p["part"], p["seq"])))[F.col("part")])
        for p in live:  # buckets that were written anew since
            if p.get("without"):
                df = df.filter(~((F.col("part") == p["part"]) & F.col("_bucket").isin(p["without"])))
        return df

    def read(self, table: str, at: Version | None = None, keep: Column | None = None) -> DataFrame:
        """The rows of a table that count, and of those where `keep`, a condition on bucket or columns, holds; LookupError if there is no such table."""
        at = at or self.version()
        known = at.tables.get(table)
        if known is None:
            raise LookupError(f"{self.folder} has no table {table}")
        shape = _shape(known["columns"])
        rows = self.parts(table, at=at)
        if rows is None:
            return self.spark.createDataFrame([], shape)
        if keep is not None:
            rows = rows.filter(keep)
        for name, (default, since) in known.get("defaults", {}).items():
            rows = rows.withColumn(name, F.when(F.col("_seq") < since, F.expr(default).cast(shape[name].dataType)).otherwise(F.col(name)))
        deletes = self.parts(table, "deletes", at)
        first = min(p["seq"] for p in known["rows"])
        later = [p for p in known.get("deletes", []) if p["seq"] > first]
        if deletes is None or not later:
            return rows.select(shape.names)
        key, buckets = known["key"], sorted({b for p in later for b in p["buckets"]})
        touched = F.col("_bucket").isin(buckets)
        gone = deletes.groupBy(*(F.col(k).alias(f"_gone_{k}") for k in key)).agg(F.max("_seq").alias("_since"))
        same = [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in key]
        alive = rows.filter(touched).join(gone, same, "left").filter("_since IS NULL OR _seq >= _since")
        whole = len(buckets) == known["buckets"]
        return alive.select(shape.names) if whole else rows.filter(~touched).select(shape.names).unionByName(alive.select(shape.names))

    def begin(self) -> Transaction:
        return Transaction(self)

    def transact(self, work: Callable[[Transaction], object], tries: int = 5) -> object:
        """`work(transaction)` and its commit; from the start, with the newer version, where another writer was faster."""
        for left in range(tries - 1, -1, -1):
            change = self.begin()
            out = work(change)
            try:
                change.commit()
                return out
            except Conflict:
                if not left:
                    raise
        return None

    def compact(self, table: str, every: bool = False) -> list[int]:
        """Write the buckets that have keys to compare, or all, anew as one part, without rows that no longer count; gives them."""
        change = self.begin()
        known = change.tables[table]
        deletes = known.get("deletes", [])
        buckets = list(range(known["buckets"])) if every else sorted({b for p in deletes for b in p["buckets"]})
        if not buckets:
            return []
        rows = self.read(table, change.base, keep=F.col("_bucket").isin(buckets))
        old = [{**p, "without": sorted({*p.get("without", []), *buckets})} for p in known["rows"]]
        old = [p for p in old if not set(p["buckets"]) <= set(p["without"])]
        rest = [{**p, "buckets": sorted(set(p["buckets"]) - set(buckets))} for p in deletes]
        change.append(table, rows)
        known = change.tables[table]
        known["rows"] = [*old, *known["rows"][-1:]]
        known["deletes"] = [p for p in rest if p["buckets"]]
        # rows of one sequence are not told apart, so defaults of added columns are written out by now
        change.commit()
        return buckets

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the parts and files of all versions but the newest `keep`, and parts of writers that broke off.

        For times without writers: a part that is still being written belongs to no version.
        """
        newest = self.version().number
        live = {(t, p["part"]) for n in range(max(1, newest - keep + 1), newest + 1) for t, known in self.version(n).tables.items() for kind in ("rows", "deletes") for p in known.get(kind, [])}
        dead = [p for p in self.files.like(f"{self.folder}/data/*/part=*") if tuple(p.replace("/part=", "/").rsplit("/", 2)[1:]) not in live]
        for p in dead:
            self.files.delete(p)
        for p in self.files.like(f"{self.folder}/versions/v*.json"):
            if int(p.rsplit("/", 1)[1][1:-5]) <= newest - keep:
                self.files.delete(p)
        return dead


class Transaction:
    """Changes against one version; nothing of them is seen before `commit`."""

    def __init__(self, store: Store):
        self.store, self.base = store, store.version()
        self.seq = self.base.number + 1
        self.tables = json.loads(json.dumps(self.base.tables))
        self.values = dict(self.base.values)

    def read(self, table: str, **given) -> DataFrame:
        """The table as it was when the transaction began."""
        return self.store.read(table, self.base, **given)

    def has(self, table: str) -> bool:
        return table in self.base.tables

    def create(self, table: str, schema: StructType, key: list[str], buckets: int = BUCKETS) -> None:
        """A table without rows, unless there is one."""
        self.tables.setdefault(table, {"key": key, "buckets": buckets, "columns": schema.json(), "rows": [], "deletes": []})

    def add_column(self, table: str, name: str, kind: str, default: str = "NULL") -> None:
        """Another column; rows that are there have the value of the SQL expression `default`."""
        known = self.tables[table]
        shape = _shape(known["columns"])
        if name in shape.names:
            raise ValueError(f"{table} has a column {name}")
        known["columns"] = shape.add(StructType.fromDDL(f"`{name}` {kind}")[0]).json()
        known.setdefault("defaults", {})[name] = [default, self.seq]

    def _write(self, table: str, kind: str, df: DataFrame, bucket: Column | None = None, order: list[str] | None = None, unpack: Callable[[DataFrame], DataFrame] | None = None) -> None:
        known = self.tables[table]
        part = uuid.uuid4().hex
        path = self.store._part(table, part)
        bucket = F.pmod(F.xxhash64(*known["key"]), F.lit(known["buckets"])).cast("int") if bucket is None else bucket
        # adaptive execution gives small buckets one file and splits very large ones
        rows = df.withColumn("_bucket", bucket).hint("rebalance", "_bucket")
        rows = rows if unpack is None else unpack(rows)
        rows.sortWithinPartitions("_bucket", *(order or known["key"])).write.partitionBy("_bucket").parquet(path)
        folders = self.store.files.like(f"{path}/_bucket=*")
        found = sorted(int(f.rsplit("=", 1)[1]) for f in folders)
        if found:
            known.setdefault(kind, []).append({"part": part, "seq": self.seq, "buckets": found})

    def append(self, table: str, df: DataFrame, bucket: Column | None = None, order: list[str] | None = None) -> None:
        """More rows; columns that `df` lacks are null."""
        shape = _shape(self.tables[table]["columns"])
        cast = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in shape]
        self._write(table, "rows", df.select(*cast), bucket, order)

    def append_packed(self, table: str, packed: DataFrame, unpack: Callable[[DataFrame], DataFrame], order: list[str], size: int) -> None:
        """More rows, which are shuffled as `packed` (`_bucket` and anything) and opened by `unpack`, to all columns and `_bucket`, where they are sorted; `size` is the bytes of packed rows for one task."""
        conf, name = self.store.spark.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
        old = conf.get(name)
        conf.set(name, str(size))
        try:
            self._write(table, "rows", packed, F.col("_bucket"), order, unpack)
        finally:
            conf.set(name, old)

    def delete(self, table: str, keys: DataFrame) -> None:
        """Rows of these keys, from before this transaction, no longer count."""
        known = self.tables[table]
        shape = _shape(known["columns"])
        keys = keys.select(*(F.col(k).cast(shape[k].dataType).alias(k) for k in known["key"])).distinct()
        known["keys"] = keys.schema.json()
        self._write(table, "deletes", keys)

    def upsert(self, table: str, df: DataFrame) -> None:
        """Rows in place of those of their keys; of equal keys in `df` all are kept."""
        self.delete(table, df)
        self.append(table, df)

    def replace(self, table: str, df: DataFrame) -> None:
        """`df` and nothing else."""
        known = self.tables[table]
        known["rows"], known["deletes"] = [], []
        self.append(table, df)

    def clear(self, table: str) -> None:
        """No rows; the columns stay."""
        self.tables[table]["rows"], self.tables[table]["deletes"] = [], []

    def commit(self) -> int:
        """Make all changes visible at once and give the version's number; Conflict if another writer has committed since the beginning.

        Without a change there is no new version.
        """
        if (self.tables, self.values) == (self.base.tables, self.base.values):
            return self.base.number
        text = json.dumps({"tables": self.tables, "values": self.values})
        if not _create(self.store.files, self.store._name(self.seq), text):
            raise Conflict(f"version {self.seq} of {self.store.folder} is taken")
        return self.seq
