"""Query registry and the role each driver table plays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` is the statement an ANSI engine runs on the same tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_values(mapping: dict[str, str], key: str = "code", value: str = "label") -> str:
    """A fixed code list as a SQL relation."""
    rows = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in mapping.items())
    return f"(SELECT * FROM (VALUES {rows}) AS v({key}, {value}))"


def persons(spark: SparkSession, sf_dir: str, joins: tuple[str, ...] = ("part", "orders", "customer")) -> DataFrame:
    """Line items as person records; only the joins a query needs are made."""
    rows = table(spark, sf_dir, "lineitem")
    partkey, suppkey = F.col("l_partkey"), F.col("l_suppkey")
    cols = {
        "PWGTP": F.col("l_quantity").cast("bigint"),
        "ANC1P": F.when(partkey % 11 != 0, F.lpad((partkey % 50).cast("string"), 4, "0")),
        "ANC2P": F.when(suppkey % 13 != 0, (suppkey % 50).cast("string")),
        "ESR": F.col("l_linenumber"),
        "PINCP": F.when(F.col("l_tax") > 0, F.col("l_extendedprice")),
        "RAC1P": F.nullif((suppkey % 9 + 1).cast("int"), F.lit(5)),
        "HICOV": F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", " 2"),
        "HINS1": F.when(F.col("l_linestatus") == "F", " 1 ").otherwise("2"),
        "HINS2": F.when(F.col("l_discount") > 0.05, "1").otherwise("2"),
        "HINS4": F.when(partkey % 3 == 0, "1").otherwise("2"),
        "PRIVCOV": F.when(F.col("l_linenumber") <= 3, "1").when(F.col("l_linenumber") <= 6, "2"),
        "FOD1P": (partkey % 5500 + 1000).cast("int"),
        "FOD2P": F.when(suppkey % 3 != 0, (suppkey * 37 % 5500 + 1000).cast("int")),
    }
    if "part" in joins:
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        cols |= {
            "SCHL": F.col("p_size"),
            "EDUCD": F.col("p_size") * 3,
            "AGEP": F.col("p_size") + 10,
            "SOCP": F.col("p_brand"),
        }
    if "orders" in joins or "customer" in joins:
        rows = rows.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        cols["NATIVITY"] = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    if "customer" in joins:
        rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        nation = F.col("c_nationkey")
        cols["STATE"] = F.when(nation != 24, F.lpad(nation.cast("string"), 2, "0"))
        cols["PUMA"] = F.col("c_mktsegment")
    return rows.select(*[c.alias(n) for n, c in cols.items()])


PERSONS = """persons AS (
  SELECT CAST(l_quantity AS BIGINT) AS "PWGTP",
    CASE WHEN l_partkey % 11 <> 0 THEN lpad(CAST(l_partkey % 50 AS VARCHAR), 4, '0') END AS "ANC1P",
    CASE WHEN l_suppkey % 13 <> 0 THEN CAST(l_suppkey % 50 AS VARCHAR) END AS "ANC2P",
    l_linenumber AS "ESR",
    CASE WHEN l_tax > 0 THEN l_extendedprice END AS "PINCP",
    NULLIF(CAST(l_suppkey % 9 + 1 AS INTEGER), 5) AS "RAC1P",
    CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN ' 2' END AS "HICOV",
    CASE l_linestatus WHEN 'F' THEN ' 1 ' ELSE '2' END AS "HINS1",
    CASE WHEN l_discount > 0.05 THEN '1' ELSE '2' END AS "HINS2",
    CASE WHEN l_partkey % 3 = 0 THEN '1' ELSE '2' END AS "HINS4",
    CASE WHEN l_linenumber <= 3 THEN '1' WHEN l_linenumber <= 6 THEN '2' END AS "PRIVCOV",
    CAST(l_partkey % 5500 + 1000 AS INTEGER) AS "FOD1P",
    CASE WHEN l_suppkey % 3 <> 0 THEN CAST(l_suppkey * 37 % 5500 + 1000 AS INTEGER) END AS "FOD2P",
    p_size AS "SCHL", p_size * 3 AS "EDUCD", p_size + 10 AS "AGEP", p_brand AS "SOCP",
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS "NATIVITY",
    CASE WHEN c_nationkey <> 24 THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS "STATE",
    c_mktsegment AS "PUMA"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey)"""

# the sub-population of the registered queries: code 7 in either slot
CODE = 7
IN_GROUP = "(TRY_CAST(\"ANC1P\" AS DOUBLE) = 7 OR TRY_CAST(\"ANC2P\" AS DOUBLE) = 7)"
SLOT_HITS = (
    "(CASE WHEN TRY_CAST(\"ANC1P\" AS DOUBLE) = 7 THEN 1 ELSE 0 END"
    " + CASE WHEN TRY_CAST(\"ANC2P\" AS DOUBLE) = 7 THEN 1 ELSE 0 END)"
)
