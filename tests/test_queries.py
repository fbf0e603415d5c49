"""Every registered query against its SQL statement on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from popweave.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, not isinstance(v, str) and v or 0, str(v)) for v in r))


SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = {d[0]: str(d[1]) for d in result.description}
    order = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert {c: SPARK_TO_SQL[df.schema[c].dataType.simpleString()] for c in columns} == names
    expected = ordered(tuple(plain(r[order.index(c)]) for c in columns) for r in result.fetchall())
    assert got == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0
