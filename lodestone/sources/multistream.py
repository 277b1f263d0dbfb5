"""Dumps made of many small compressed streams, read in parallel by the index that names where each begins.

A multistream dump is one file of bzip2 streams of some hundred pages each, and its index has
a line `offset:page id:title` for each page. Streams can be opened alone: the index, a
table, is grouped to one row for each stream, streams outside the wanted ids are dropped
before the dump is opened, and the others are dealt to tasks that seek to their offset
and stop at the stream's own end. A stream that is damaged costs only what it holds, and it
is told how many of its pages were lost.

Dumps are opened inside tasks through Arrow's file systems (local or mounted paths, HDFS,
S3, GCS). The index is read by Spark, compressed or not.
"""

from __future__ import annotations

import bz2
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.cluster import ship
from lodestone.sources.wiki_dump import parsed

#: Streams of a task, some tens of megabytes.
STREAMS = 64
#: Bytes read at a time; a stream of more pages than fit is still one row for each page.
CHUNK = 1 << 18
_PAGE = re.compile(rb"<page[\s>].*?</page>", re.DOTALL)
_READ = "stream bigint, n_pages bigint, xml string, error string"


def stream_index(spark: SparkSession, index: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(stream, n_pages, first_id, last_id) of the streams that hold any of the ids; lines that are none are dropped."""
    parts = F.split("value", ":", 3)
    number = lambda i: F.expr(f"try_cast(get(_parts, {i}) AS BIGINT)")
    lines = spark.read.text(index).select(parts.alias("_parts")).select(number(0).alias("stream"), number(1).alias("page_id")).filter("stream >= 0 AND page_id IS NOT NULL")
    streams = lines.groupBy("stream").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"))
    if first_id is not None:
        streams = streams.filter(F.col("last_id") >= first_id)
    return streams if last_id is None else streams.filter(F.col("first_id") <= last_id)


def read_streams(spark: SparkSession, dump: str, index: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(stream, n_pages, xml, error): a row for each page of the streams, and a row with an error for each stream that does not give all pages of its index.

    Pages before the damage of a stream are kept where they can be read.
    """
    ship(spark)
    streams = stream_index(spark, index, first_id, last_id).select("stream", "n_pages")
    # counted from the index alone; adaptive execution would put such small rows into one task,
    # also where it can reuse the partitions of the grouping, hence the hash
    tasks = max(spark.sparkContext.defaultParallelism, -(-streams.count() // STREAMS))
    schema = pa.schema([("stream", pa.int64()), ("n_pages", pa.int64()), ("xml", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = path = None
        for batch in batches:
            for at, wanted in sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if system is None:
                    system, path = FileSystem.from_uri(dump)
                found = 0
                error = None
                with system.open_input_file(path) as file:
                    pages = _pages(file, at)
                    while True:
                        try:
                            some = next(pages, None)
                        except (OSError, EOFError) as e:
                            error = str(e)
                            break
                        if some is None:
                            break
                        found += len(some)
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array([at] * n), pa.array([wanted] * n), pa.array(some, pa.string()), pa.nulls(n, pa.string())], schema=schema)
                if error is not None or found != wanted:
                    told = f"{found} of {wanted} pages" + (f": {error}" if error else "")
                    yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([wanted]), pa.nulls(1, pa.string()), pa.array([told])], schema=schema)

    return streams.repartition(tasks, F.xxhash64("stream")).mapInArrow(run, _READ)


def _pages(file, at: int) -> Iterator[list[str]]:
    """Page elements of the stream that begins at a byte of a file, as they come; OSError where it is damaged, EOFError where the file ends."""
    if at >= file.size():
        raise EOFError("the file ends before the stream")
    file.seek(at)
    stream, rest = bz2.BZ2Decompressor(), b""
    while not stream.eof:
        if stream.needs_input:
            packed = file.read(CHUNK)
            if not packed:
                raise EOFError("the file ends inside the stream")
        else:
            packed = b""
        rest += stream.decompress(packed, max_length=16 * CHUNK)
        some, end = [], 0
        for m in _PAGE.finditer(rest) if b"</page>" in rest else ():
            some.append(m[0].decode("utf-8", "replace"))
            end = m.end()
        rest = rest[end:]
        if some:
            yield some


def stream_pages(spark: SparkSession, dump: str, index: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Raw pages as `wiki_dump.read_dump` gives them, of the ids from `first_id` to `last_id`."""
    read = read_streams(spark, dump, index, first_id, last_id).filter("error IS NULL")
    pages = parsed(read, F.col("xml"))
    number = F.expr("try_cast(trim(id) AS BIGINT)")
    if first_id is not None:
        pages = pages.filter(number >= first_id)
    return pages if last_id is None else pages.filter(number <= last_id)


def damage(streams: DataFrame) -> DataFrame:
    """(stream, n_pages, error) of the streams of `read_streams` that gave less or more than their index says."""
    return streams.filter("error IS NOT NULL").select("stream", "n_pages", "error")
