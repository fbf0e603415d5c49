"""Queries whose ids outgrow the width of their keys, against their SQL statements."""

import duckdb
import pytest

from popweave.catalog import ORACLES, QUERIES
from popweave.catalog.shapes import ALBERS_SQL
from popweave.functions import geometry as G

from test_queries import SF_DIR, ordered, plain


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """The smallest embeddings with ids on both sides of 100,000: ids of six digits share their first five."""
    path = tmp_path_factory.mktemp("wide")
    duckdb.connect().execute(
        f"COPY (SELECT vec_id + 99930 AS vec_id, embedding, label FROM '{SF_DIR}/embeddings.parquet') TO '{path}/embeddings.parquet'"
    )
    return str(path)


@pytest.mark.parametrize("name", ["build_crosswalk", "map_table", "shapes_with_estimates"])
def test_ids_wider_than_the_key(spark, wide, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{wide}/embeddings.parquet'")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    expected = ordered(tuple(plain(v) for v in r) for r in result.fetchall())
    assert max(len(r[names.index("zip")]) for r in expected) == 5
    assert ordered(tuple(plain(r[c]) for c in names) for r in QUERIES[name](spark, wide).collect()) == expected


def test_projection_constants_are_those_of_the_statement():
    """To the last bit: targets whose estimate lies half way between two numbers are rounded by it."""
    found = duckdb.connect().execute(f"WITH {ALBERS_SQL} SELECT e, n, c, rho0 FROM consts").fetchall()
    assert found == [tuple(G.ALBERS[k] for k in ("e", "n", "c", "rho0"))]


def test_targets_of_a_wide_grid_stay_apart(spark, tmp_path):
    """A grid of 402 by 402 in two cells of which all rows lie; both their targets are shown as 00200."""
    con = duckdb.connect()
    con.execute(
        f"""COPY (SELECT CASE WHEN r % 3 = 0 THEN 400 ELSE 2 * 402 END AS p_partkey, CAST(r % 7 + 1 AS INTEGER) AS p_size,
          10.0::DOUBLE AS p_retailprice FROM range(402 * 402) t(r)) TO '{tmp_path}/part.parquet'"""
    )
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    expected = con.execute(ORACLES["estimates_from_shapes"]).fetchall()
    assert [r[0] for r in expected] == ["00200", "00200"]
    got = QUERIES["estimates_from_shapes"](spark, str(tmp_path)).select("zip", "estimate", "moe").collect()
    assert ordered(tuple(r) for r in got) == ordered(expected)
