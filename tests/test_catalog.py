"""Every query with SQL against DuckDB over the smallest tables; the others for a stable schema."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tessella import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    mine = sorted("|".join(map(plain, r)) for r in found.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted("|".join(map(plain, r)) for r in duck.sql(f"SELECT {names} FROM ({catalog.ORACLES[name]})").fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_does_not_depend_on_partitions(spark, name):
    """Their parts are held against plain versions elsewhere; here: there are rows, all known, and the same on other partitions."""
    rows = []
    for partitions in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = catalog.QUERIES[name](spark, SMALL)
        rows.append(sorted("|".join(map(plain, r)) for r in found.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] and rows[0] and found.columns


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_detectors_see_whole_texts(spark, tmp_path):
    turns = [(1, 1, "user", "x " * 40 + "have 12 wheels"), (2, 1, "user", "x " * 40 + "have wheels")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.conv_id: r.works for r in catalog.QUERIES["working_detector"](spark, str(tmp_path)).collect()} == {1: True, 2: False}
    items = [(1, "lisbon that is nice and cheap near the old harbour")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert catalog.QUERIES["place_questions"](spark, str(tmp_path)).first().price == "Budget"
