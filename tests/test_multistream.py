"""Multistream dumps: the same pages as a whole read, many tasks, ranges of ids, damage that stays where it is."""

import bz2
from xml.sax.saxutils import escape

import pytest

from lodestone.sources import multistream as M
from lodestone.sources import wiki_dump as W

SIZE = 7


@pytest.fixture(scope="module")
def dump(spark, sf_dir, tmp_path_factory):
    """A dump of the documents, with an index, as the paths of both and the offsets of the streams."""
    folder = tmp_path_factory.mktemp("dump")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(100).collect()
    clean = lambda t: "".join(c for c in t if c >= " " or c in "\n\t")
    page = lambda r: (
        f"<page><title>T:{r.doc_id}</title><ns>{r.doc_id % 3}</ns><id>{r.doc_id}</id><revision><id>{r.doc_id + 5}</id>"
        f"<timestamp>2024</timestamp><text bytes='3' xml:space='preserve'>{escape(clean(r.text or ''))}</text></revision></page>\n"
    )
    out, lines, offsets = bytearray(bz2.compress(b"<mediawiki><siteinfo></siteinfo>\n")), [], []
    for k in range(0, len(rows), SIZE):
        offsets.append(len(out))
        lines += [f"{len(out)}:{r.doc_id}:T:{r.doc_id}" for r in rows[k : k + SIZE]]
        out += bz2.compress("".join(map(page, rows[k : k + SIZE])).encode())
    out += bz2.compress(b"</mediawiki>")
    (folder / "x.xml.bz2").write_bytes(out)
    (folder / "index.txt.bz2").write_bytes(bz2.compress("\n".join([*lines, "no line", ""]).encode()))
    return folder, offsets, [r.doc_id for r in rows]


def rows_of(pages):
    return sorted(map(tuple, W.articles(pages, None).collect()))


def test_same_pages_in_many_tasks(spark, dump):
    folder, offsets, _ = dump
    file, index = str(folder / "x.xml.bz2"), str(folder / "index.txt.bz2")
    read = M.read_streams(spark, file, index)
    assert rows_of(M.stream_pages(spark, file, index)) == rows_of(W.read_dump(spark, file))
    assert M.damage(read).count() == 0 and read.rdd.getNumPartitions() > 1
    assert rows_of(M.stream_pages(spark, f"file://{file}", index)) == rows_of(W.read_dump(spark, file))


def test_ranges_open_their_streams_only(spark, dump):
    folder, offsets, ids = dump
    file, index = str(folder / "x.xml.bz2"), str(folder / "index.txt.bz2")
    first, last = ids[SIZE + 2], ids[2 * SIZE + 3]
    got = rows_of(M.stream_pages(spark, file, index, first, last))
    assert [r[0] for r in got] == [i for i in ids if first <= i <= last]
    assert {r.stream for r in M.read_streams(spark, file, index, first, last).collect()} == set(offsets[1:3])
    assert M.stream_pages(spark, file, index, ids[-1] + 1).count() == 0
    assert [r[0] for r in rows_of(M.stream_pages(spark, file, index, last_id=ids[0]))] == ids[:1]


def test_damage_stays_in_its_stream(spark, dump, tmp_path):
    folder, offsets, ids = dump
    data = bytearray((folder / "x.xml.bz2").read_bytes())
    middle = (offsets[3] + offsets[4]) // 2
    data[middle : middle + 20] = bytes(20)
    file, index = tmp_path / "cut.xml.bz2", str(folder / "index.txt.bz2")
    file.write_bytes(data[: offsets[-2] + 40])  # the last stream is missing, the one before cut
    read = M.read_streams(spark, str(file), index)
    told = {r.stream: (r.n_pages, r.error) for r in M.damage(read).collect()}
    assert set(told) == {offsets[3], offsets[-2], offsets[-1]}
    assert told[offsets[3]][0] == SIZE and told[offsets[-1]][1].startswith("0 of ")
    lost = {*ids[3 * SIZE : 4 * SIZE], *ids[(len(offsets) - 2) * SIZE :]}
    assert [r[0] for r in rows_of(M.stream_pages(spark, str(file), index))] == [i for i in ids if i not in lost]


def test_wrong_counts_and_empty_index(spark, dump, tmp_path):
    folder, offsets, ids = dump
    more = tmp_path / "index.txt"
    more.write_text(f"{offsets[0]}:{ids[0]}:a\n{offsets[0]}:{ids[1]}:b:c\n{10**12}:5:far\nx:1:y\n:\n")
    file = str(folder / "x.xml.bz2")
    read = M.read_streams(spark, file, str(more))
    assert read.filter("xml IS NOT NULL").count() == SIZE
    assert {r.stream: r.error.split(":")[0] for r in M.damage(read).collect()} == {offsets[0]: f"{SIZE} of 2 pages", 10**12: "0 of 1 pages"}
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert M.read_streams(spark, file, str(empty)).count() == 0
