"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(x):
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    relation = duck.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"SELECT {quoted} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in expected), key=repr)


def test_every_query_without_sql_is_listed():
    assert not set(entry.oracle_sql()) - set(entry.queries())
