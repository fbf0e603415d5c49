"""Queries that have a SQL statement, against it."""

import duckdb
import pytest

from popweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    expected = sorted(tuple(r) for r in result.fetchall())
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == expected
    assert expected and ("contaminated" not in names or any(r[names.index("contaminated")] for r in expected))
