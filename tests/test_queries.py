"""Every query runs, and gives the rows of its SQL."""

import pytest

from lodestone.plans import catalog
from tests.oracle import spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    columns, rows = spark_rows(catalog.QUERIES[name](spark, sf_dir))
    if name in catalog.ORACLE_SQL:
        wanted_columns, wanted = sql_rows(sf_dir, catalog.ORACLE_SQL[name])
        assert columns == wanted_columns
        assert rows == wanted
    else:
        assert columns


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_queue_takes_all_pages(spark, sf_dir):
    asked = catalog.QUERIES["queue_states"](spark, sf_dir).select("title")
    drained = catalog.QUERIES["queue_drain"](spark, sf_dir).select("title")
    assert asked.join(drained, "title", "left_anti").count() == 0


def test_last_of_equal_lines_stands_first_in_the_table(few, tmp_path):
    """Spark reads the larger file first; of lines of one order and number the one in the first file and row counts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    (tmp_path / "lineitem.parquet").mkdir()
    for name, n, part in (("part-0", 50, 1_000), ("part-1", 5_000, 100_000)):
        at = range(n)
        lines = {"l_orderkey": [i % 25 for i in at], "l_linenumber": [1 + i % 2 for i in at], "l_partkey": [part + i for i in at]}
        pq.write_table(pa.table(lines, schema=pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_partkey", pa.int64())])), tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = {tuple(r) for r in catalog.QUERIES["last_wins"](few, str(tmp_path)).collect()}
    assert got == {(k, 2, 1_000 + (k if k % 2 else k + 25)) for k in range(25)}
