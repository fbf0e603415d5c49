"""Queries on estimates, rankings, joins, directories and country tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import query, sql_values, table
from popweave.functions import codes as C
from popweave.functions.numbers import (
    coefficient_of_variation,
    count_int,
    half_even,
    lenient_sum,
    num,
    safe_div,
    strict_sum,
    total,
)
from popweave.functions.predicates import (
    above_weight,
    comparable,
    drop_missing,
    flagged,
    folded_equals,
    in_codes,
    year_month_between,
)
from popweave.functions.text import zero_pad
from popweave.operators import joins as J, ranking as R, schema as S, weighted as W
from popweave.plans import education as E, estimates as P, microdata as M


# --- scalar functions -------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_extendedprice + l_quantity END AS strict,
  CASE WHEN l_tax > 0 THEN l_extendedprice ELSE 0 END + l_quantity AS lenient FROM lineitem""")
def strict_row_sum(spark, d):
    price = F.when(F.col("l_tax") > 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", strict_sum(price, "l_quantity").alias("strict"),
        lenient_sum(price, F.col("l_quantity")).alias("lenient"),
    )


@query("""SELECT l_linenumber, round(sum(CASE WHEN l_tax > 0 THEN l_quantity ELSE 0 END + l_linenumber), 2) AS total
FROM lineitem GROUP BY 1""")
def row_sum_prefix(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_linenumber",
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).cast("string").alias("CTOTALT"),
        F.col("l_linenumber").cast("string").alias("CTOTALX"),
        F.lit("99").alias("CIPCODE"),
        F.col("l_partkey").alias("other"),
    )
    summed = W.row_sum_by_prefix(rows, ["CTOTAL", "CIP"], "n", ["CIPCODE"])
    return W.group_sum(summed, ["l_linenumber"], "n", "total").withColumn("total", F.round("total", 2))


@query("""SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(0 AS BIGINT) AS bad,
  CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS price FROM orders""")
def count_commas(spark, d):
    orders = table(spark, d, "orders")
    price = F.col("o_totalprice")
    return orders.select(
        "o_orderkey",
        count_int(F.format_number(F.floor(price), 0)).alias("n"),
        count_int(F.concat(F.lit("n/a "), F.col("o_orderstatus"))).alias("bad"),
        F.round(num(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" "), price.cast("decimal(12,2)").cast("string")))
                    .otherwise("--")), 2).alias("price"),
    )


@query("""SELECT c_custkey, CAST(round_even(c_custkey / 2, 0) AS BIGINT) AS half,
  CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey, 6) END AS ratio FROM customer""")
def half_even_and_safe_division(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", half_even(F.col("c_custkey") / 2).alias("half"),
        F.round(safe_div("c_acctbal", "c_nationkey"), 6).alias("ratio"),
    )


@query("""SELECT n_nationkey, n_name, CASE n_nationkey WHEN 0 THEN '06' WHEN 1 THEN '36' WHEN 2 THEN '72' ELSE '12' END AS code
FROM nation""")
def abbreviation_codes(spark, d):
    abbr = F.when(F.col("n_nationkey") == 0, " ca").when(F.col("n_nationkey") == 1, "NY").when(
        F.col("n_nationkey") == 2, "pr").otherwise("FL")
    return table(spark, d, "nation").select("n_nationkey", "n_name", C.state_code(abbr).alias("code"))


# --- labels -----------------------------------------------------------------------------------------------------


@query(f"""SELECT c_custkey, coalesce(label, lpad(CAST(c_nationkey AS VARCHAR), 2, '0')) AS name, label AS known
FROM customer LEFT JOIN {sql_values(C.STATE_NAMES)} ON code = lpad(CAST(c_nationkey AS VARCHAR), 2, '0')""")
def label_default(spark, d):
    state = zero_pad("c_nationkey", 2)
    return table(spark, d, "customer").select(
        "c_custkey", C.label(state, C.STATE_NAMES).alias("name"), C.lookup(state, C.STATE_NAMES).alias("known")
    )


@query("""SELECT p_partkey,
  CASE WHEN given IS NULL OR trim(given) = p_brand THEN CASE p_brand WHEN 'Brand#1' THEN 'One' WHEN 'Brand#2' THEN 'Two'
    ELSE coalesce(given, p_brand) END ELSE given END AS fallback,
  CASE p_brand WHEN 'Brand#1' THEN 'One' WHEN 'Brand#2' THEN 'Two' ELSE coalesce(given, p_brand) END AS override
FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN p_brand || ' ' END AS given FROM part)""")
def label_tiers(spark, d):
    titles = {"Brand#1": "One", "Brand#2": "Two"}
    given = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(
        F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit(" "))
    )
    return table(spark, d, "part").withColumn("given", given).select(
        "p_partkey",
        C.fallback_label("p_brand", "given", titles).alias("fallback"),
        C.override_label("p_brand", "given", titles).alias("override"),
    )


@query("""SELECT r_name, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def lookup_joins(spark, d):
    nations = J.lookup_join(table(spark, d, "customer"), table(spark, d, "nation"), {"c_nationkey": "n_nationkey"}, "inner")
    regions = table(spark, d, "region").where("r_name <> 'ASIA'")
    return J.lookup_join(nations, regions, {"n_regionkey": "r_regionkey"}).select("r_name", "n_name", "c_custkey")


@query("""SELECT c_custkey AS k, coalesce(CASE WHEN o.n > 5 THEN o.n END, CAST(c_nationkey AS BIGINT)) AS n, c_mktsegment AS segment
FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def join_preferring_right(spark, d):
    left = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("n"), F.col("c_mktsegment").alias("segment")
    )
    right = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    right = right.withColumn("n", F.when(F.col("n") > 5, F.col("n")))
    return J.join_preferring_right(left, right, ["k"])


@query("""SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (
  SELECT s_nationkey FROM supplier GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4) AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def membership(spark, d):
    suppliers = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    top = R.top_n(suppliers, [("n", "desc"), "s_nationkey"], 4)
    rows = table(spark, d, "customer").where(in_codes("c_mktsegment", ["BUILDING", "MACHINERY"]))
    return J.keep_members(rows, "c_nationkey", top, "s_nationkey").select("c_custkey", "c_nationkey")


# --- filters ----------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS n FROM customer WHERE lower(trim('  ' || c_mktsegment || ' ')) = 'building'""")
def ci_filter(spark, d):
    padded = F.concat(F.lit("  "), F.initcap("c_mktsegment"), F.lit(" "))
    return table(spark, d, "customer").where(folded_equals(padded, "Building")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderpriority, count(*) AS n FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y
  FROM orders) WHERE (y IS NULL OR y * 100 + month(o_orderdate) BETWEEN 199603 AND 199810)
  AND o_orderpriority <> '1-URGENT' GROUP BY 1""")
def ym_window(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("y"),
        F.month("o_orderdate").alias("m"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
    )
    rows = orders.where(year_month_between("y", "m", "1996-03", "1998-10") & flagged("urgent", False))
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS kept, count(*) FILTER (t IS NOT NULL OR q IS NOT NULL) AS not_empty,
  count(*) FILTER (share > 0.5) AS heavy FROM (
  SELECT CASE WHEN l_tax > 0.04 THEN l_tax END AS t, CASE WHEN l_quantity > 25 THEN l_quantity END AS q,
    l_discount * 10 AS share FROM lineitem) WHERE q IS NOT NULL""")
def missing_and_threshold_filters(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("t"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("q"),
        (F.col("l_discount") * 10).alias("share"),
    )
    some = drop_missing(drop_missing(rows, ["q"]))
    return some.agg(
        F.count("*").alias("kept"),
        F.count_if(F.col("t").isNotNull() | F.col("q").isNotNull()).alias("not_empty"),
        F.count_if(above_weight("share", 0.5)).alias("heavy"),
    )


# --- ranking ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def topn_global(spark, d):
    return R.top_n(table(spark, d, "orders"), [("o_totalprice", "desc"), "o_orderkey"], 12).select("o_orderkey", "o_totalprice")


@query("""SELECT p_name, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY n, p_name) AS place FROM (
  SELECT replace(p_name, ' ring', '') AS p_name, sum(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)""")
def topn_resort(spark, d):
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy(F.replace("p_name", F.lit(" ring"), F.lit("")).alias("p_name")).agg(
        F.sum("l_quantity").cast("bigint").alias("n")
    )
    top = R.top_n_resorted(counts, [("n", "desc"), "p_name"], 15, ["n", "p_name"])
    return top.withColumn("place", F.row_number().over(Window.orderBy("n", "p_name")).cast("bigint"))


@query("""SELECT o_custkey, y, o_orderkey FROM (SELECT o_custkey, o_orderkey, y,
  row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC NULLS FIRST, o_orderkey DESC) AS r FROM (
  SELECT *, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS y FROM orders)) WHERE r = 1""")
def latest_per_key(spark, d):
    orders = table(spark, d, "orders").select(
        "o_custkey", F.when(F.col("o_orderkey") % 17 != 0, F.year("o_orderdate")).alias("y"), "o_orderkey"
    )
    return R.latest_per_key(orders, ["o_custkey"], "y", ["o_orderkey"])


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def dedupe_first(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return R.first_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT conv_id, min(CASE WHEN turn < 50 AND role = 'assistant' THEN turn END) AS turn FROM conversations GROUP BY 1""")
def first_match_index(spark, d):
    turns = table(spark, d, "conversations")
    return R.first_match_index(turns, ["conv_id"], "turn", F.col("role") == "assistant")


@query("""SELECT l_orderkey, l_partkey, l_quantity, CASE WHEN k IS NOT NULL THEN sum(l_quantity) OVER (PARTITION BY k) END AS whole
FROM (SELECT *, nullif(l_partkey % 20, 3) AS k FROM lineitem)""")
def group_total_on_rows(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", F.nullif(F.col("l_partkey") % 20, F.lit(3)).alias("k")
    )
    return R.with_group_total(rows, ["k"], "l_quantity", "whole").drop("k")


@query("""SELECT p_brand, round(m / max(m) OVER (), 9) AS scaled FROM (SELECT p_brand, max(p_retailprice) AS m FROM part GROUP BY 1)""")
def scaled_to_max(spark, d):
    peaks = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("m"))
    return W.scaled_to_max(peaks, "m", "scaled").select("p_brand", F.round("scaled", 9).alias("scaled"))


@query("""SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier""")
def union_by_name(spark, d):
    customers = S.tag(
        table(spark, d, "customer").select(
            F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
        ), kind="customer")
    suppliers = S.tag(
        table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")),
        kind="supplier")
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("""SELECT s_suppkey AS id, s_name AS title, CAST(NULL AS VARCHAR) AS note, s_acctbal AS amount FROM supplier""")
def schema_resolution(spark, d):
    raw = table(spark, d, "supplier").toDF(" S_SuppKey", "S_NAME ", "s_nationkey", "Acct Bal")
    named = S.normalize_columns(raw)
    S.require_columns(named, ["s_suppkey"])
    named = S.rename_alternates(named, {"amount": ["balance", "acct bal"]})
    balance = S.pick_column_regex(named, [r"\bTotal\b", r"^amount$"])
    slim = S.keep_columns(named, ["s_suppkey", "s_name", "not_there", balance])
    tidy = S.tidy(slim, {"id": S.pick_column(slim, ["key", "S_SUPPKEY"]), "title": "S_NAME", "amount": balance})
    return S.conform(tidy, {"id": "bigint", "title": "string", "note": "string", "amount": "double"})


# --- directories, completions, country tables -------------------------------------------------------------------

DIRECTORY_SQL = """facts AS (SELECT CAST(o_custkey AS VARCHAR) AS unitid, CAST(year(l_shipdate) AS INTEGER) AS year,
    CAST(sum(l_quantity) AS BIGINT) AS ctotal FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
  directory AS (SELECT CAST(o_custkey AS VARCHAR) AS unitid, CAST(year(o_orderdate) AS INTEGER) AS year,
    o_orderpriority || '/' || o_orderkey AS instnm, o_orderstatus || month(o_orderdate) AS stabbr FROM orders
    WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1),
  latest AS (SELECT * FROM directory QUALIFY row_number() OVER (PARTITION BY unitid ORDER BY year DESC) = 1)"""


def _facts(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(
        F.col("o_custkey").cast("string").alias("unitid"), F.year("l_shipdate").alias("year")
    ).agg(F.sum("l_quantity").cast("bigint").alias("ctotal"))


def _directory(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").cast("string").alias("unitid"),
        F.year("o_orderdate").alias("year"),
        F.concat("o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string")).alias("instnm"),
        F.concat("o_orderstatus", F.month("o_orderdate").cast("string")).alias("stabbr"),
        "o_orderdate",
        "o_orderkey",
    )
    first = R.first_per_key(orders, ["unitid", "year"], ["o_orderdate", "o_orderkey"])
    return first.select("unitid", "year", "instnm", "stabbr")


@query(f"""WITH {DIRECTORY_SQL}
SELECT f.unitid, f.year, f.ctotal, coalesce(s.instnm, l.instnm) AS instnm, coalesce(s.stabbr, l.stabbr) AS stabbr
FROM facts f LEFT JOIN directory s ON f.unitid = s.unitid AND f.year = s.year LEFT JOIN latest l ON f.unitid = l.unitid""")
def directory_join_fallback(spark, d):
    rows = E.completions_by_field(_facts(spark, d), _directory(spark, d))
    return rows.select("unitid", "year", "ctotal", "instnm", "stabbr")


@query(f"""WITH {DIRECTORY_SQL}
SELECT f.unitid, f.year, f.ctotal, l.instnm, l.stabbr FROM facts f LEFT JOIN latest l ON f.unitid = l.unitid""")
def directory_join_all(spark, d):
    return J.join_directory(_facts(spark, d), _directory(spark, d), "unitid", "year", ["instnm", "stabbr"], "all")


def _completions(spark, d):
    """Orders as completions rows of their customers, customers as institutions of their nation."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").alias("UnitID"),
        F.lit("01.0101").alias("CIPCODE"),
        F.rint("o_totalprice").cast("bigint").cast("string").alias("CTOTALT"),
        F.rint("o_totalprice").cast("bigint").cast("string").alias("CTOTALM"),
        (F.col("o_orderkey") % 10).alias("AWARDS"),
        F.col("o_orderkey"),
    )
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("unitid"), F.col("c_nationkey").alias("stabbr"), F.col("c_name").alias("instnm")
    )
    return E.completions_with_state(orders, customers)


@query(f"""SELECT c_nationkey AS "STATE", CAST(sum(2 * round_even(o_totalprice, 0) + o_orderkey % 10) AS DOUBLE)
  AS total_completions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def completions_by_state(spark, d):
    return E.completions_by_state(_completions(spark, d))


@query("""SELECT "STATE", "INSTNM", total_completions FROM (SELECT *,
  row_number() OVER (PARTITION BY "STATE" ORDER BY total_completions DESC, "INSTNM", o_orderkey) AS r FROM (
    SELECT c_nationkey AS "STATE", c_name AS "INSTNM", o_orderkey,
      CAST(2 * round_even(o_totalprice, 0) + o_orderkey % 10 AS DOUBLE) AS total_completions
    FROM orders JOIN customer ON o_custkey = c_custkey)) WHERE r <= 10""")
def top_completions(spark, d):
    return E.top_completions(_completions(spark, d), 10, ["INSTNM", "o_orderkey"])


@query("""SELECT "STATE", "INSTNM", total_completions FROM (SELECT *,
  row_number() OVER (PARTITION BY "STATE" ORDER BY total_completions DESC, "INSTNM") AS r FROM (
    SELECT c_nationkey AS "STATE", c_name AS "INSTNM",
      CAST(sum(2 * round_even(o_totalprice, 0) + o_orderkey % 10) AS DOUBLE) AS total_completions
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE r <= 3""")
def top_institutions(spark, d):
    return E.top_completions(_completions(spark, d), 3, merge=True)


COUNTRY_SQL = """origins AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_name AS instnm,
    CASE WHEN c_nationkey <> 5 THEN 'S' || c_nationkey END AS stabbr, CAST(floor(o_totalprice) AS BIGINT) AS students
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_custkey % 50 <> 0)"""


def _origins(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    raw = rows.select(
        F.year("o_orderdate").cast("string").alias("Academic_Year"),
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_name")).alias("Institution"),
        F.when(F.col("c_nationkey") != 5, F.concat(F.lit("S"), F.col("c_nationkey").cast("string"))).alias("State"),
        F.floor("o_totalprice").cast("string").alias("Total"),
        F.concat(F.lit(" "), F.initcap("c_mktsegment")).alias("place_of_origin"),
    )
    return E.country_table(raw, "building")


@query(f"WITH {COUNTRY_SQL} SELECT * FROM origins")
def country_table(spark, d):
    return _origins(spark, d)


@query(f"""WITH {COUNTRY_SQL} SELECT year, stabbr, CAST(sum(students) AS BIGINT) AS students FROM origins
WHERE stabbr IS NOT NULL GROUP BY 1, 2""")
def country_by_state(spark, d):
    return E.country_by_state(_origins(spark, d))


@query(f"""WITH {COUNTRY_SQL} SELECT stabbr,
  {", ".join(f'CAST(coalesce(sum(students) FILTER (year = {y}), 0) AS BIGINT) AS "{y}"' for y in range(1995, 2002))} FROM origins
WHERE stabbr IS NOT NULL GROUP BY 1""")
def country_state_pivot(spark, d):
    return E.country_state_pivot(E.country_by_state(_origins(spark, d)))


@query("""SELECT 'S' || c_nationkey AS state, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders
JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1""")
def snapshot_by_state(spark, d):
    return E.snapshot_summary(_snapshot(spark, d), "Machinery")["state"]


@query("""SELECT c_name AS institution, 'S' || c_nationkey AS state, CAST(sum(floor(o_totalprice)) AS BIGINT) AS total FROM orders
JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' GROUP BY 1, 2""")
def snapshot_by_school(spark, d):
    return E.snapshot_summary(_snapshot(spark, d), "Machinery")["school"]


def _snapshot(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.upper("c_mktsegment").alias("Country of Citizenship"),
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("StateAbbrv"),
        F.col("c_name").alias("U.S. School"),
        F.format_number(F.floor("o_totalprice"), 0).alias("Count of Active STEM Students"),
    )


# --- summary estimates and figure tables ------------------------------------------------------------------------

ESTIMATES_SQL = """raw AS (SELECT c_name AS name, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state,
  lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS county, CAST(c_custkey AS DOUBLE) AS single,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_nationkey AS DOUBLE) END AS multiple FROM customer)"""


def _summary_rows(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_name").alias("NAME"),
        zero_pad("c_nationkey", 2).alias("state"),
        zero_pad((F.col("c_custkey") % 1000).cast("string"), 3).alias("county"),
        F.col("c_custkey").cast("string").alias("single"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey").cast("string")).otherwise("(X)").alias("multiple"),
    )


@query(f"""WITH {ESTIMATES_SQL} SELECT name AS "NAME", single, multiple, state AS state_fips, single + multiple AS total,
  coalesce(label, state) AS state_name FROM raw LEFT JOIN {sql_values(C.STATE_NAMES)} ON state = code""")
def state_estimates(spark, d):
    return P.state_estimates(_summary_rows(spark, d).drop("county"), ["single", "multiple"])


@query(f"""WITH {ESTIMATES_SQL} SELECT name AS "NAME", single, multiple, state AS state_fips, county AS county_fips,
  single + multiple AS total FROM raw WHERE state = '06'""")
def county_estimates(spark, d):
    return P.county_estimates(_summary_rows(spark, d), ["single", "multiple"], "6")


@query(f"""WITH {ESTIMATES_SQL} SELECT name AS "NAME", multiple, state AS state_fips, coalesce(label, state) AS state_name
FROM raw LEFT JOIN {sql_values(C.STATE_NAMES)} ON state = code""")
def birthplace_by_state(spark, d):
    return P.birthplace_by_state(_summary_rows(spark, d), "multiple")


@query(f"""WITH {ESTIMATES_SQL} SELECT name AS "NAME", state, CAST(coalesce(multiple, 0) AS BIGINT) AS "count" FROM raw""")
def counts_from_summary(spark, d):
    return P.counts_by_state(_summary_rows(spark, d), "multiple")


@query(f"""WITH {ESTIMATES_SQL} SELECT replace(name, 'Customer#', '') AS label, single + multiple AS total FROM raw
WHERE state = '06' ORDER BY total DESC NULLS LAST, name LIMIT 15""")
def top_counties(spark, d):
    counties = P.county_estimates(_summary_rows(spark, d), ["single", "multiple"], "06")
    return P.top_counties(counties, "Customer#").select("label", "total")


def _state_counts(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = lines.select(zero_pad("s_nationkey", 2).alias("STATE"), F.col("l_quantity").cast("bigint").alias("w"))
    return W.weighted_count(rows, ["STATE"], "w")


STATE_COUNTS_SQL = """counts AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state_fips,
  CAST(sum(l_quantity) AS BIGINT) AS weighted_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""
VISIBILITY_SQL = f"""ancestry AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_fips,
    (SELECT CAST(count(*) AS DOUBLE) FROM customer WHERE c_nationkey = n_nationkey) AS ancestry FROM nation),
  births AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS state_fips,
    CAST(count(*) - 3 AS DOUBLE) AS born FROM supplier GROUP BY 1), {STATE_COUNTS_SQL},
  combo AS (SELECT a.state_fips, coalesce(label, a.state_fips) AS state, ancestry, born, weighted_count,
    round(20 + 80 * sqrt(coalesce(weighted_count, 0) / (SELECT max(weighted_count) FROM counts)), 6) AS size,
    CASE WHEN born > 0 THEN round(ancestry / born, 9) END AS ratio
  FROM ancestry a LEFT JOIN births b ON a.state_fips = b.state_fips LEFT JOIN counts c ON a.state_fips = c.state_fips
  LEFT JOIN {sql_values(C.STATE_POSTAL)} ON a.state_fips = code)"""


def _visibility(spark, d):
    customers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    nations = table(spark, d, "nation")
    ancestry = J.lookup_join(nations, customers, {"n_nationkey": "c_nationkey"}).select(
        F.col("n_nationkey").cast("string").alias("state_fips"), F.coalesce("n", F.lit(0)).alias("ancestry")
    )
    births = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("state_fips")).agg(
        (F.count("*") - 3).cast("string").alias("born")
    )
    combo = P.visibility_table(ancestry, births, _state_counts(spark, d))
    return combo.withColumns({"size": F.round("size", 6), "ratio": F.round("ratio", 9)})


@query(f"WITH {VISIBILITY_SQL} SELECT * FROM combo")
def marker_scale(spark, d):
    return _visibility(spark, d)


@query(f"""WITH {VISIBILITY_SQL} SELECT * FROM combo WHERE born > 0 AND ancestry IS NOT NULL
ORDER BY ancestry DESC, state_fips LIMIT 8""")
def visibility_ratio(spark, d):
    return P.visibility_ratios(_visibility(spark, d), annotate=8)


@query(f"WITH {VISIBILITY_SQL} SELECT state_fips, ancestry, born FROM combo WHERE born <= 60 AND ancestry <= 60")
def dense_cluster(spark, d):
    return P.dense_cluster(_visibility(spark, d), 60).select("state_fips", "ancestry", "born")


@query(f"""WITH {STATE_COUNTS_SQL} SELECT state_fips AS "STATE", weighted_count, coalesce(label, state_fips) AS postal
FROM counts LEFT JOIN {sql_values(C.STATE_POSTAL)} ON state_fips = code ORDER BY weighted_count DESC, 1 LIMIT 12""")
def top_states(spark, d):
    return P.top_states(_state_counts(spark, d))


@query(f"""SELECT CAST(l_linenumber AS INTEGER) AS "RAC1P", CAST(sum(l_quantity) AS BIGINT) AS weighted_count,
  CASE l_linenumber WHEN 1 THEN 'White alone' WHEN 2 THEN 'Black alone' WHEN 6 THEN 'Asian alone'
  ELSE 'RAC1P ' || l_linenumber END AS label FROM lineitem GROUP BY l_linenumber ORDER BY weighted_count DESC, 1 LIMIT 5""")
def prefixed_labels(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("RAC1P"), F.col("l_quantity").cast("bigint").alias("w"))
    return P.labelled_counts(W.weighted_count(rows, ["RAC1P"], "w"), "RAC1P", C.RACE_LABELS, prefix="RAC1P", n=5)


@query("""SELECT nation.n_nationkey AS shape_key, c.total, c.label FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS total,
  'N' || c_nationkey AS label FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) c ON n_nationkey = c_nationkey
WHERE n_regionkey = 1""")
def county_map(spark, d):
    shapes = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("STATEFP"), zero_pad("n_nationkey", 3).alias("COUNTYFP"),
        F.col("n_nationkey").alias("shape_key"),
    )
    counties = table(spark, d, "customer").where("c_nationkey % 2 = 0").groupBy("c_nationkey").agg(F.count("*").alias("total"))
    counties = counties.select(
        F.col("c_nationkey").cast("string").alias("county_fips"), "total",
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("label"),
    )
    return P.county_map(shapes, counties, "1").select("shape_key", "total", "label")


@query("""SELECT p_partkey, CASE WHEN est > 0 THEN round(p_retailprice / 100 / 1.645 / est, 9) END AS cv FROM part LEFT JOIN (
  SELECT l_partkey, sum(CASE WHEN l_linenumber > 2 THEN l_quantity ELSE 0 END) AS est FROM lineitem GROUP BY 1)
  ON p_partkey = l_partkey""")
def cv(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        total(F.when(F.col("l_linenumber") > 2, F.col("l_quantity"))).alias("est")
    )
    rows = J.lookup_join(table(spark, d, "part"), sums, {"p_partkey": "l_partkey"})
    value = coefficient_of_variation("est", F.col("p_retailprice") / 100)
    return rows.select("p_partkey", F.round(value, 9).alias("cv"))


@query("""SELECT count(*) AS n FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem
  GROUP BY 1) ON p_partkey = l_partkey WHERE coalesce(q, 0) > 0 AND CASE WHEN p_size % 5 <> 0 THEN p_size END IS NOT NULL""")
def comparable_rows(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    rows = J.lookup_join(table(spark, d, "part"), sums, {"p_partkey": "l_partkey"})
    size = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    return rows.where(comparable(size, "q")).agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT o_orderstatus AS "NATIVITY", CASE o_orderstatus WHEN 'F' THEN 'U.S. native' WHEN 'O' THEN 'Foreign-born'
  ELSE 'P' END AS label, CAST(count(*) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS weighted_count FROM orders""")
def nativity_labels(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("NATIVITY")).agg(
        F.count("*").alias("weighted_count")
    )
    return P.labelled_counts(counts, "NATIVITY", {"F": C.NATIVITY_LABELS["1"], "O": C.NATIVITY_LABELS["2"]})


@query("""SELECT CAST(lpad(CAST(n AS VARCHAR), 2, '0') AS VARCHAR) AS state FROM (
  SELECT s_nationkey AS n, count(*) AS c FROM supplier GROUP BY 1 ORDER BY c DESC, lpad(CAST(n AS VARCHAR), 2, '0') LIMIT 5)""")
def largest_states(spark, d):
    counts = table(spark, d, "supplier").groupBy(zero_pad("s_nationkey", 2).alias("state")).agg(F.count("*").alias("n"))
    return M.largest_states(counts, "n", 5)
