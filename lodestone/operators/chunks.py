"""Chunks for embedding: articles by section, tables, infoboxes; papers by heading."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestone.cluster import ship
from lodestone.functions import text as X
from lodestone.functions import wikitext as W

MAX_CHARS = 1600
_HEADING = re.compile(X.HEADING)


def packed(df: DataFrame, key: str, text: str, limit: int = MAX_CHARS) -> DataFrame:
    """(key, chunk_index, text, text_length): paragraphs packed up to `limit` characters."""
    parts = F.posexplode(X.pack_paragraphs(F.col(text), limit)).alias("chunk_index", "text")
    return df.select(key, parts).withColumn("text_length", F.char_length("text"))


def _sections(df: DataFrame, key: str, sections, limit: int) -> DataFrame:
    """Bodies packed and numbered within their section; white-space runs of blank lines become one, empty bodies go."""
    one = df.select(key, F.posexplode(sections).alias("section_index", "s"))
    body = F.regexp_replace(F.col("s.body"), r"\n[ \t]*\n\s*", "\n\n")
    chunks = one.select(key, "section_index", F.col("s.section").alias("section"), body.alias("body")).filter("body <> ''")
    return chunks.select(key, "section_index", "section", F.posexplode(X.pack_paragraphs(F.col("body"), limit)).alias("chunk_index", "text")).withColumn("text_length", F.char_length("text"))


def article_chunks(df: DataFrame, key: str, title: str, text: str, limit: int = MAX_CHARS) -> DataFrame:
    """Chunks of articles that are no redirects: (key, place, chunk_type, section_index, section, chunk_index, text, text_length).

    `place` is their order: the article's info boxes, then for each section its tables
    before its prose. The lead's section is null. Info boxes are numbered through the
    article, table parts within their table and prose within its section. Sections are
    cut before tables, so a heading inside a table leaves it unclosed.
    """
    ship(df.sparkSession)
    prose = df.filter(~X.is_redirect(F.col(text)))
    kind = df.schema[key].dataType.simpleString()
    names = [key, "place", "chunk_type", "section_index", "section", "chunk_index", "text", "prose"]
    schema = StructType.fromDDL(f"`{key}` {kind}, place int, chunk_type string, section_index int, section string, chunk_index int, text string, prose boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, *row) for i, (t, x) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)) for row in _pieces(t or "", x, limit)]
                columns = list(zip(*rows, strict=True)) or [()] * 8
                arrays = [part.column(0).take(pa.array(columns[0], type=pa.int64()))]
                arrays += [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns[1:], schema.fields[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    pieces = prose.select(F.col(key), F.col(title), F.col(text)).mapInArrow(run, schema)
    # prose is packed by column functions; what is whole already passes as it is
    parts = F.when(F.col("prose"), X.pack_paragraphs(F.col("text"), limit)).otherwise(F.array("text"))
    split = pieces.select(key, "place", "chunk_type", "section_index", "section", F.col("chunk_index").alias("_own"), "prose", F.posexplode(parts).alias("_n", "text"))
    number = F.when(F.col("prose"), F.col("_n")).otherwise(F.col("_own"))
    return split.filter("text <> ''").select(
        key, "place", "chunk_type", "section_index", "section", number.alias("chunk_index"), "text", F.char_length("text").alias("text_length")
    )


def _pieces(title: str, text: str, limit: int) -> Iterator[tuple]:
    """(place, kind, section number, section, index, text, prose) of one article."""
    text = W.inline_formulas(text)
    place = 0
    for number, part in enumerate(p for head, lines in W.info_boxes(text, title) for p in W.packed_lines(head, lines, limit)):
        yield place, "infobox", 0, None, number, part, False
        place += 1
    ends = [m.span() for m in _HEADING.finditer(text)]
    sections = [(None, text[: ends[0][0] if ends else len(text)])]
    sections += [(m[2], text[m.end() : nxt]) for m, nxt in zip(_HEADING.finditer(text), [*(a for a, _ in ends[1:]), len(text)], strict=False)]
    for at, (section, body) in enumerate(sections):
        tables, rest = W.cut_tables(body)
        for head, lines in tables:
            for number, part in enumerate(W.packed_lines(head, lines, limit)):
                yield place, "table", at, section, number, part, False
                place += 1
        rest = re.sub(r"\n{3,}", "\n\n", W.plain(rest))
        if rest:
            yield place, "prose", at, section, 0, rest, True
            place += 1


def paper_chunks(df: DataFrame, key: str, markdown: str, limit: int = MAX_CHARS) -> DataFrame:
    """Chunks of markdown between headings of two to six signs; the lead's section is ''."""
    marked = F.regexp_replace(F.col(markdown), r"(?m)^#{2,6}[ \t]+(.+?)[ \t]*$", "\u0001$1\u0002")
    parts = F.transform(
        F.split(marked, "\u0001"),
        lambda p: F.struct(
            F.when(p.contains("\u0002"), F.substring_index(p, "\u0002", 1)).otherwise("").alias("section"),
            F.regexp_replace(F.when(p.contains("\u0002"), F.substring_index(p, "\u0002", -1)).otherwise(p), r"^\s+|\s+$", "").alias("body"),
        ),
    )
    return _sections(df, key, parts, limit)


def table_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_index, heading, row_index, row): the rows of all closed tables as `header: value | header: value`."""
    return _exploded(df, key, text, "table_index int, heading string, row_index int, row string", lambda t, _: _numbered(W.cut_tables(t)[0]))


def infobox_fields(df: DataFrame, key: str, text: str, title: str) -> DataFrame:
    """(key, box_index, heading, field_index, field): the `field: value` lines of a page's info boxes in order."""
    return _exploded(df, key, text, "box_index int, heading string, field_index int, field string", lambda t, own: _numbered(W.info_boxes(t, own)), title)


def _numbered(found: list[tuple[str, list[str]]]) -> list[tuple]:
    return [(k, head, j, line) for k, (head, lines) in enumerate(found) for j, line in enumerate(lines)]


def _exploded(df: DataFrame, key: str, text: str, fields: str, rows_of: Callable[[str, str], list[tuple]], title: str | None = None) -> DataFrame:
    ship(df.sparkSession)
    schema = StructType.fromDDL(f"`{key}` {df.schema[key].dataType.simpleString()}, {fields}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = batch.column(2).to_pylist()
            rows = [(i, *r) for i, t in enumerate(batch.column(1).to_pylist()) for r in rows_of(t or "", titles[i] or "")]
            columns = list(zip(*rows, strict=True)) or [()] * len(schema.fields)
            arrays = [batch.column(0).take(pa.array(columns[0], type=pa.int64()))]
            arrays += [pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns[1:], schema.fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(F.col(key), F.col(text), (F.col(title) if title else F.lit("")).alias("_title")).mapInArrow(run, schema)
