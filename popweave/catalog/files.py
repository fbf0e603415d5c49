"""File formats: each query writes what Spark derives from the driver tables to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from popweave.catalog.registry import CODE, IN_GROUP, PERSONS, persons, query, table
from popweave.functions import geometry as G
from popweave.functions.text import zero_pad
from popweave.operators.joins import lookup_join
from popweave.plans import education as E, microdata as M
from popweave.session import scratch_path
from popweave.sinks import files as W
from popweave.sources import delimited as D, geojson as J, responses as H


@query(f"""WITH {PERSONS} SELECT "STATE", "PUMA", "PWGTP", "ANC1P", "ANC2P", CAST("ESR" AS BIGINT) AS "ESR", "PINCP" FROM persons WHERE {IN_GROUP}""")
def csv_extract(spark, d):
    """Chunked scan of person files: filter and pruning happen in the scan's stage."""
    people = persons(spark, d, ("customer",)).select("STATE", "PUMA", "PWGTP", "ANC1P", "ANC2P", "ESR", "PINCP")
    path = W.write_csv(people, scratch_path(spark, "persons"))
    return M.extract_population(D.scan_csv(spark, path, glob="part-*.csv"), CODE)


@query("""SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus = 'F' AS flag, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2""")
def partitioned_snapshots(spark, d):
    rows = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        (F.col("o_orderstatus") == "F").alias("flag"), "o_orderkey",
    )
    path = W.write_snapshots(rows, scratch_path(spark, "snapshots"))
    back = spark.read.option("header", True).csv(path).where("year = 1997")
    return back.groupBy(F.col("year").cast("int").alias("year"), F.col("flag").cast("boolean").alias("flag")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys")
    )


def _put_csv(spark, rows, folder: str, name: str, encoding: str = "UTF-8") -> None:
    """CSV files whose own names tell the year, as those of published files do."""
    rows.write.option("header", True).option("encoding", encoding).option("escape", '"').csv(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in files.listStatus(path(folder)) if f.getPath().getName().startswith("part-")]
    for i, part in enumerate(parts):
        files.rename(part, path(f"{folder}/{name}_{i}.csv"))


def _completions_folder(spark, d) -> str:
    """Yearly files: other column order, other spelling, Latin-1 text, one without a total, one without a year."""
    root = scratch_path(spark, "completions")
    orders = table(spark, d, "orders").select(
        F.year("o_orderdate").alias("y"),
        F.col("o_custkey").cast("string").alias("UNITID"),
        F.concat(F.lit("0"), (F.col("o_orderkey") % 90).cast("string"), F.lit(".01")).alias("CIPCODE"),
        F.substring("o_orderpriority", 1, 1).alias("AWLEVEL"),
        F.rint("o_totalprice").cast("bigint").cast("string").alias("CTOTALT"),
        F.col("o_orderkey").cast("string").alias("CIPTITLE"),
    )

    def put(rows, name: str, encoding: str = "UTF-8"):
        _put_csv(spark, rows, f"{root}/{name}", f"c{name}", encoding)

    put(orders.where("y = 1995").drop("y"), "1995")
    put(orders.where("y = 1996").select("CIPTITLE", F.col("CTOTALT").alias(" ctotal_t"), "AWLEVEL", "CIPCODE", "UNITID",
                                        F.lit("1").alias("MAJOR_NUM")), "1996")
    accented = orders.where("y = 1997").withColumn("CIPTITLE", F.concat(F.lit("ét"), "CIPTITLE"))
    put(accented.drop("y"), "1997", "ISO-8859-1")
    put(orders.where("y = 1998").drop("y", "CTOTALT"), "1998")
    # both spellings in one file: the first one counts there, empty or not
    first = F.when(F.col("CIPTITLE").cast("bigint") % 2 == 0, F.col("CTOTALT"))
    put(orders.where("y >= 1999").drop("y").withColumn("CTOTALT", first).withColumn("CTOTAL_T", F.lit("9")), "1999")
    return root


@query("""SELECT CAST(least(year(o_orderdate), 1999) AS INTEGER) AS year, CAST(o_custkey AS VARCHAR) AS unitid, '0' || (o_orderkey % 90) || '.01' AS cipcode,
  CASE WHEN year(o_orderdate) = 1996 THEN '1' END AS majornum, substr(o_orderpriority, 1, 1) AS awlevel,
  CASE WHEN year(o_orderdate) = 1997 THEN 'ét' ELSE '' END || o_orderkey AS ciptitle,
  CASE WHEN year(o_orderdate) >= 1999 AND o_orderkey % 2 = 1 THEN 0 ELSE CAST(round_even(o_totalprice, 0) AS BIGINT) END AS ctotal
FROM orders WHERE year(o_orderdate) <> 1998""")
def drifting_csv_union(spark, d):
    """All years but the one whose file has no total and is skipped."""
    root = _completions_folder(spark, d)
    return E.load_completions(spark, [f"{root}/{year}" for year in range(1995, 2000)])


@query("""WITH done AS (SELECT CAST(least(year(o_orderdate), 1999) AS INTEGER) AS year, o_custkey, '0' || (o_orderkey % 90) || '.01' AS cipcode,
    CASE WHEN year(o_orderdate) = 1997 THEN 'ét' ELSE '' END || o_orderkey AS ciptitle, substr(o_orderpriority, 1, 1) AS awlevel,
    CASE WHEN year(o_orderdate) = 1996 THEN '1' END AS majornum,
    CASE WHEN year(o_orderdate) >= 1999 AND o_orderkey % 2 = 1 THEN 0 ELSE CAST(round_even(o_totalprice, 0) AS BIGINT) END AS ctotal
  FROM orders WHERE year(o_orderdate) <> 1998),
placed AS (SELECT done.*, c_name, c_nationkey, CASE
    WHEN year = 1995 AND o_custkey % 3 <> 0 THEN 1995 WHEN o_custkey % 3 <> 1 THEN 1997 ELSE 1995 END AS of_year
  FROM done JOIN customer ON o_custkey = c_custkey)
SELECT year, CAST(o_custkey AS VARCHAR) AS unitid, c_name || of_year AS instnm, 'S' || c_nationkey AS stabbr, cipcode, ciptitle, awlevel,
  majornum, ctotal FROM placed""")
def completions_job(spark, d):
    """Yearly completions with the institution of the same year's directory, else of the latest that has it."""
    root = _completions_folder(spark, d)
    customer = table(spark, d, "customer")
    key = F.col("c_custkey")

    def put(rows, year: int, state: str):
        named = rows.select(
            key.cast("string").alias("UNITID"), F.concat("c_name", F.lit(str(year))).alias("INSTNM"),
            F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias(state),
        )
        _put_csv(spark, named, f"{root}/directory{year}", f"hd{year}")

    put(customer.where(key % 3 != 0), 1995, "STABBR")
    put(customer.where(key % 3 != 1), 1997, "STATE_ABBR")
    completions = E.load_completions(spark, [f"{root}/{year}" for year in range(1995, 2000)])
    directory = E.load_directory(spark, [f"{root}/directory{year}" for year in (1995, 1997)])
    return E.completions_by_field(completions, directory)


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2023 WHEN 1 THEN 1999 END AS year FROM orders""")
def year_from_file_name(spark, d):
    name = F.when(F.col("o_orderkey") % 3 == 0, "C2023_A.csv").when(F.col("o_orderkey") % 3 == 1, "hd1999.csv").otherwise("hd.csv")
    return table(spark, d, "orders").select("o_orderkey", D.year_from_name(name).alias("year"))


def _response(key, est, state, reverse):
    """One header-first response page per row, as text; half the pages have another column order and a lone header."""
    row = F.when(reverse, F.array(state, est, key)).otherwise(F.array(key, est, state))
    head = F.when(reverse, F.array(F.lit("state"), F.lit("E"), F.lit("NAME"))).otherwise(
        F.array(F.lit("NAME"), F.lit("E"), F.lit("state"))
    )
    return F.to_json(F.array(head, row), {"ignoreNullFields": "false"})


@query("""SELECT c_name AS "NAME", CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS "E",
  CAST(c_nationkey AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS "M" FROM customer""")
def header_json_rows(spark, d):
    est = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string"))
    docs = table(spark, d, "customer").select(
        _response(F.col("c_name"), est, F.col("c_nationkey").cast("string"), F.col("c_custkey") % 2 == 0).alias("doc")
    )
    return H.header_rows(docs, "doc", ["NAME", "E", "state", "M"])


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "NAME", CAST(o_totalprice AS VARCHAR) AS "E", o_orderstatus AS state FROM orders""")
def paged_responses(spark, d):
    """A folder of landed response pages, one to a line, read as one table."""
    docs = table(spark, d, "orders").select(
        _response(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus"),
                  F.col("o_orderkey") % 2 == 0).alias("value"),
    )
    path = scratch_path(spark, "responses")
    docs.write.text(path)
    return H.scan_header_json(spark, path, per_line=True).select("NAME", "E", "state")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS label, count(*) AS n
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL""")
def code_lists(spark, d):
    """Code lists whose values are text or an object, joined to the rows that use the codes."""
    entry = F.when(F.col("p_size") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("label"), F.col("p_size").alias("other"))))
    value = F.coalesce(entry, F.concat(F.lit('"'), "p_type", F.lit('"')))
    docs = table(spark, d, "part").select(
        F.concat(F.lit('{"name": "x", "values": {"'), F.col("p_partkey").cast("string"), F.lit('": '), value, F.lit("}}")).alias("doc")
    )
    used = table(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("code")).agg(F.count("*").alias("n"))
    return lookup_join(H.code_list(docs, "doc"), used, ["code"], "inner").select("code", "label", "n")


def _squares(spark, d):
    rows = table(spark, d, "customer")
    x, y, r = F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double"), F.lit(0.25)
    outer = G.box_polygon(x, y, x + 2, y + 2)
    holed = F.array(F.concat(F.get(outer, F.lit(0)), F.get(G.box_polygon(x + r, y + r, x + 1, y + 1), F.lit(0))))
    two = F.concat(outer, G.box_polygon(x + 3, y, x + 4, y + 1))
    geom = F.when(rows["c_custkey"] % 3 == 0, outer).when(rows["c_custkey"] % 3 == 1, holed).otherwise(two)
    return rows.select(F.col("c_custkey").cast("string").alias("GEOID20"), F.col("c_mktsegment").alias("segment"), geom.alias("geom"))


@query("""SELECT lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS zip, c_mktsegment AS segment,
  CASE c_custkey % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 3.4375 ELSE 5.0 END::DOUBLE AS area FROM customer""")
def geojson_lines(spark, d):
    path = W.write_geojson(_squares(spark, d), scratch_path(spark, "geojson"))
    shapes = J.feature_ids(J.scan_geojson(spark, path, layout="feature_lines"), ["ZCTA5CE20", "GEOID20", "GEOID"], "zip", 5)
    return shapes.select("zip", F.try_element_at("properties", F.lit("segment")).alias("segment"), G.area("geom").alias("area"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 2 AS INTEGER) AS parts, 1.0::DOUBLE AS area FROM customer""")
def geojson_collections(spark, d):
    """One small FeatureCollection document per row, polygons and multipolygons."""
    x = F.col("c_custkey").cast("string")
    ring = F.concat(F.lit("[["), x, F.lit(",0],["), x, F.lit(",1],["), (F.col("c_custkey") + 1).cast("string"), F.lit(",1],["),
                    (F.col("c_custkey") + 1).cast("string"), F.lit(",0],["), x, F.lit(",0]]"))
    geometry = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))).otherwise(
        F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("]]}")))
    doc = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"GEOID":"'), x,
                   F.lit('"},"geometry":'), geometry, F.lit("}]}"))
    path = scratch_path(spark, "collections")
    table(spark, d, "customer").select(doc.alias("value")).write.text(path)
    shapes = J.scan_geojson(spark, path, layout="collection_lines")
    kind = (F.try_element_at("properties", F.lit("GEOID")).cast("bigint") % 2).cast("int")
    return shapes.select(
        F.try_element_at("properties", F.lit("GEOID")).alias("id"), kind.alias("parts"), G.area("geom").alias("area")
    )


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, 2.0::DOUBLE AS area FROM customer""")
def geojson_files(spark, d):
    """Files of one FeatureCollection each, written over several lines, of five hundred customers at most."""
    x, y = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    right, top = (F.col("c_custkey") + 2).cast("string"), (F.col("c_nationkey") + 1).cast("string")
    corners = [(x, y), (right, y), (right, top), (x, top), (x, y)]
    ring = F.concat_ws(",", *[F.concat(F.lit("["), a, F.lit(","), b, F.lit("]")) for a, b in corners])
    feature = F.concat(F.lit('{"type":"Feature",\n"properties":{"GEOID":"'), x, F.lit('","segment":"'), "c_mktsegment",
                       F.lit('"},\n"geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}"))
    rows = table(spark, d, "customer").select(F.floor(F.col("c_custkey") / 500).alias("part"), feature.alias("feature"))
    text = F.concat(F.lit('{"type":"FeatureCollection",\n"features":['), F.array_join(F.collect_list("feature"), ",\n"), F.lit("]}"))
    path = scratch_path(spark, "geojson-files")
    rows.groupBy("part").agg(text.alias("value")).write.partitionBy("part").text(path)
    shapes = J.scan_geojson(spark, path)
    named = [F.try_element_at("properties", F.lit(p)).alias(n) for p, n in (("GEOID", "id"), ("segment", "segment"))]
    return shapes.select(*named, G.area("geom").alias("area"))


@query("""SELECT lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS zip, count(DISTINCT l_partkey) AS sources FROM lineitem GROUP BY l_suppkey""")
def crosswalk_artifact(spark, d):
    pairs = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    made = pairs.select(zero_pad("l_suppkey", 5).alias("zip"), zero_pad("l_partkey", 11).alias("tract"), "weight")
    path = W.write_parquet(made, scratch_path(spark, "crosswalk"))
    return spark.read.parquet(path).groupBy("zip").agg(F.count("*").alias("sources"))
