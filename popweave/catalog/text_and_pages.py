"""Text, link and web-page queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from popweave.catalog.registry import query, table
from popweave.functions import text as T
from popweave.plans import snapshots as N
from popweave.session import even_parts
from popweave.sources import pages as P


@query("""SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS padded,
  right(c_name, 4) AS tail, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || right(c_name, 6) AS area FROM customer""")
def zero_pad_ids(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", T.zero_pad("c_custkey", 3).alias("padded"), T.last_chars("c_name", 4).alias("tail"),
        T.area_id(T.zero_pad("c_nationkey", 2), T.last_chars("c_name", 6)).alias("area"),
    )


@query("""SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '(\\d+)', 1), '') AS digits,
  nullif(regexp_extract(o_orderstatus, '(\\d+)', 1), '') AS none, CAST(regexp_extract(json_extract_string(j, '$.k'), '\\d+') AS VARCHAR) AS k
FROM orders, (SELECT '{"k": "a7b9"}' AS j)""")
def digits_extract(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", T.first_digits("o_orderpriority").alias("digits"), T.first_digits("o_orderstatus").alias("none"),
        T.first_digits(F.get_json_object(F.lit('{"k": "a7b9"}'), "$.k")).alias("k"),
    )


@query("""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (
  SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS t FROM pages)""")
def strip_tags(spark, d):
    stripped = table(spark, d, "pages").select("page_id", T.strip_tags("html").alias("t"))
    return stripped.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


# an element first, then its target in double, single or no quotes
ANCHORS_SQL = """elements AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s.*?</a\\s*>') AS found FROM pages),
numbered AS (SELECT page_id, url, unnest(found) AS element, unnest(range(len(found))) AS link_no FROM elements),
anchors AS (SELECT page_id, url, link_no,
  trim(regexp_extract(element, '(?is)^[^>]*?\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1), '"''') AS href,
  regexp_replace(element, '(?is)^<a[^>]*>|</a\\s*>$', '', 'g') AS body FROM numbered)"""


@query(f"""WITH {ANCHORS_SQL} SELECT page_id, CAST(link_no AS INTEGER) AS link_no, href, trim(regexp_replace(body, '<.*?>', '', 'g')) AS "text"
FROM anchors""")
def all_links(spark, d):
    return P.extract_links(table(spark, d, "pages"), ["page_id"])


@query(f"""WITH {ANCHORS_SQL} SELECT 'https://data.example.org' || href AS url, trim(regexp_replace(body, '<.*?>', '', 'g')) AS "text",
  CAST(NULL AS INTEGER) AS year, CAST(NULL AS INTEGER) AS month, FALSE AS flag FROM anchors WHERE contains(href, 'th') AND href LIKE '%e'
QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, link_no) = 1""")
def links_catalogue(spark, d):
    return P.link_catalogue(table(spark, d, "pages"), "https://data.example.org", "STEM", contains="th", ends="e")


@query(f"""WITH {ANCHORS_SQL} SELECT page_id, CAST(link_no AS INTEGER) AS link_no,
  regexp_extract(url, '^(https?://[^/?#]*)', 1) || href AS target FROM anchors""")
def resolved_links(spark, d):
    links = P.extract_links(table(spark, d, "pages"), ["page_id", "url"])
    return links.select("page_id", "link_no", T.resolve_url("href", "url").alias("target"))


CAPTION_SQL = """captions AS (SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority,
  CASE WHEN o_orderkey % 11 = 0 THEN 'undated' ELSE strftime(o_orderdate, '%B %Y') END
  || CASE WHEN o_orderstatus = 'F' THEN ' STEM ' ELSE ' SYSTEM ' END || 'Mapping Data' AS caption FROM orders)"""


def _captions(spark, d):
    dated = F.when(F.col("o_orderkey") % 11 == 0, "undated").otherwise(F.date_format("o_orderdate", "MMMM yyyy"))
    word = F.when(F.col("o_orderstatus") == "F", " STEM ").otherwise(" SYSTEM ")
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", "o_orderdate",
        F.concat(dated, word, F.lit("Mapping Data")).alias("caption"),
    )


@query(f"""WITH {CAPTION_SQL} SELECT o_orderkey, caption,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month, o_orderstatus = 'F' AS flag,
  CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m') || CASE WHEN o_orderstatus = 'F' THEN '-stem' ELSE '' END
    ELSE 'p' || o_orderkey END AS slug FROM captions""")
def caption_parse(spark, d):
    rows = _captions(spark, d)
    year, month = T.caption_month("caption")
    url = F.concat(F.lit("https://data.example.org/tool/p"), F.col("o_orderkey").cast("string"), F.lit("-data/"))
    parsed = rows.select("o_orderkey", "caption", year.alias("year"), month.alias("month"),
                         T.caption_flag("caption", "STEM").alias("flag"), url.alias("url"))
    slug = T.snapshot_slug(F.col("year"), F.col("month"), F.col("flag"), F.col("url"), "stem", "-data")
    return parsed.select("o_orderkey", "caption", "year", "month", "flag", slug.alias("slug"))


@query(f"""WITH {CAPTION_SQL} SELECT 'https://data.example.org/tool/p' || (o_orderkey - o_orderkey % 3) || '-data' AS url, caption AS "text",
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month, o_orderstatus = 'F' AS flag FROM captions
QUALIFY row_number() OVER (PARTITION BY o_orderkey - o_orderkey % 3 ORDER BY o_orderkey) = 1""")
def dated_links_catalogue(spark, d):
    """Index pages with one data link each, in three kinds of quotes; pages share links, and the first page's caption counts."""
    key = F.col("o_orderkey")
    target = F.concat(F.lit("/tool/p"), (key - key % 3).cast("string"), F.lit("-data"))
    quote = F.when(key % 4 == 0, "'").when(key % 4 == 1, "").otherwise('"')
    link = F.concat(F.lit('<p><a href="/about">About</a> <A class=x HREF='), quote, target, quote, F.lit("><b>"), "caption", F.lit("</b></a>"))
    pages = _captions(spark, d).select(key.alias("page_id"), link.alias("html"))
    return P.link_catalogue(pages, "https://data.example.org", "STEM", contains="tool", ends="-data")


# --- pages made from orders: each order is a monthly page whose table has a small decoy table before it -----------


def _html(spark, d, spread: bool = True):
    """One page per order; some lack a state column, some have their header further down, some only a CSV link."""
    n = F.format_number(F.floor("o_totalprice"), 0)
    key = F.col("o_orderkey")
    state = F.concat(F.lit("S"), (key % 5).cast("string"))
    cell = lambda c: F.concat(F.lit("<td> "), c, F.lit(" </td>"))
    kind = key % 4
    head_full = "<tr><th>Country of Citizenship</th><th>StateAbbrv</th><th>School Name</th><th>Active Students</th></tr>"
    head_plain = "<thead><tr><th>CoC</th><th>Count</th></tr></thead>"
    origin = F.when(key % 3 == 0, "ARUBA").when(key % 3 == 1, "Aruba").otherwise("Peru")
    full = F.concat(
        F.lit(f"<table>{head_full}<tr>"), cell(origin), cell(state), cell(F.col("o_orderpriority")), cell(n),
        F.lit(f"</tr>{head_full}<tr>"), cell(F.lit("aruba")), cell(F.lit("S9")), cell(F.lit("A &amp; B")), cell(F.lit("1,001")),
        F.lit("</tr></table>"),
    )
    plain = F.concat(F.lit(f"<table>{head_plain}<tbody><tr>"), cell(origin), cell(n), F.lit("</tr></tbody></table>"))
    one_row = F.concat(F.lit("<TABLE class=x><tr>"), cell(F.lit("Country")), cell(n), F.lit("</tr></TABLE>"))
    link = F.concat(F.lit('<a class="b" href = "files/d'), key.cast("string"), F.lit('.csv?a=1&amp;b=2">get</a>'))
    body = F.when(kind == 0, full).when(kind == 1, plain).when(kind == 2, one_row).otherwise(link)
    decoy = F.when(kind < 2, "<table><tr><td>menu</td></tr></table><table></table>").otherwise("")
    html = F.concat(F.lit("<html><body><h1>"), F.col("caption"), F.lit("</h1>"), decoy, body, F.lit("</body></html>"))
    dated = F.when(key % 11 != 0, F.col("o_orderdate"))
    # orders may sit in one small file; its narrow rows are spread before they grow into pages that take long to parse
    captions = _captions(spark, d)
    if spread:
        captions = captions.repartition(even_parts(table(spark, d, "orders")), "o_orderkey")
    return captions.select(
        F.concat(F.lit("https://data.example.org/tool/p"), key.cast("string")).alias("url"), key.alias("o_orderkey"),
        html.alias("html"), F.year(dated).alias("year"), F.month(dated).alias("month"), (F.col("o_orderstatus") == "F").alias("flag"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, trim(format('{:,}', CAST(floor(o_totalprice) AS BIGINT))) AS n,
    CASE o_orderkey % 3 WHEN 0 THEN 'ARUBA' WHEN 1 THEN 'Aruba' ELSE 'Peru' END AS c FROM orders),
head AS (SELECT 'Country of Citizenship|StateAbbrv|School Name|Active Students' AS h)
SELECT k AS o_orderkey, 0 AS table_no, CAST(0 AS INTEGER) AS row_no, 'menu' AS cells FROM o WHERE k % 4 < 2
UNION ALL SELECT k, 1, CAST(r AS INTEGER), CASE r WHEN 0 THEN h WHEN 1 THEN c || '|S' || (k % 5) || '|' || p || '|' || n WHEN 2 THEN h
  ELSE 'aruba|S9|A & B|1,001' END FROM o, head, range(4) t(r) WHERE k % 4 = 0
UNION ALL SELECT k, 1, CAST(r AS INTEGER), CASE r WHEN 0 THEN 'CoC|Count' ELSE c || '|' || n END FROM o, range(2) t(r) WHERE k % 4 = 1
UNION ALL SELECT k, 0, 0, 'Country|' || n FROM o WHERE k % 4 = 2""")
def html_tables(spark, d):
    cells = P.table_cells(P.extract_html_tables(_html(spark, d)), ["o_orderkey"])
    return cells.select("o_orderkey", "table_no", "row_no", F.concat_ws("|", "cells").alias("cells"))


@query("""SELECT 'https://data.example.org/tool/p' || o_orderkey AS url,
  CASE o_orderkey % 4 WHEN 2 THEN 'headerless' WHEN 3 THEN 'csv_link' ELSE 'table' END AS source,
  CASE o_orderkey % 4 WHEN 0 THEN 'Country of Citizenship|StateAbbrv|School Name|Active Students' WHEN 1 THEN 'CoC|Count'
    WHEN 2 THEN 'Country|' || trim(format('{:,}', CAST(floor(o_totalprice) AS BIGINT))) END AS header,
  CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS n_rows,
  CASE WHEN o_orderkey % 4 = 3 THEN 'https://data.example.org/tool/files/d' || o_orderkey || '.csv?a=1&b=2' END AS csv_url FROM orders""")
def source_priority(spark, d):
    tables = P.main_table(P.extract_html_tables(_html(spark, d)), tokens=N.HEADER_TOKENS)
    return tables.select("url", "source", F.array_join("header", "|").alias("header"), F.size("rows").alias("n_rows"), "csv_url")


@query("""SELECT 'https://data.example.org/tool/p' || o_orderkey AS url, 'table' AS source, CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 1 END AS n_rows
FROM orders WHERE o_orderkey % 4 < 2""")
def repeat_header_drop(spark, d):
    cleaned = N.page_table(_html(spark, d)).where("source = 'table'")
    return cleaned.select("url", "source", F.size("rows").alias("n_rows"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 60 < 50 THEN 'Country|Active Students' END AS header,
  CAST(CASE WHEN o_orderkey % 60 < 50 THEN 1 ELSE o_orderkey % 60 + 2 END AS INTEGER) AS n_rows,
  CASE WHEN o_orderkey % 60 < 50 THEN 'x|' || o_orderkey ELSE 'note|' END AS first_row FROM orders""")
def header_promote(spark, d):
    """The header stands below some note rows; only the first fifty rows are looked at."""
    key = F.col("o_orderkey")
    note = F.array(F.lit("note"), F.lit(""))
    notes = F.array_repeat(note, (key % 60).cast("int"))
    body = F.array(F.array(F.lit("Country "), F.lit("Active Students")), F.array(F.lit("x"), key.cast("string")))
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(notes, body).alias("rows"))
    made = P.promote_header(rows, "rows", N.HEADER_TOKENS)
    return made.select(
        "o_orderkey", F.array_join("header", "|").alias("header"), F.size("rows").alias("n_rows"),
        F.array_join(F.get("rows", F.lit(0)), "|").alias("first_row"),
    )


SNAPSHOT_SQL = """o AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey % 3 < 2 AS hit, o_orderstatus = 'F' AS flag,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month FROM orders)"""


def _snapshot_tables(spark, d):
    pages = _html(spark, d)
    links = N.wanted_links(_html(spark, d, spread=False).select("url", "year", "month", "flag"), start="1996-01")
    return N.snapshot_tables(links, pages)


@query(f"""WITH {SNAPSHOT_SQL}, w AS (SELECT * FROM o WHERE year IS NULL OR year >= 1996)
SELECT year, month, flag, 'S' || (o_orderkey % 5) AS state, n AS total FROM w WHERE o_orderkey % 4 = 0 AND hit
UNION ALL SELECT year, month, flag, 'S9', 1001 FROM w WHERE o_orderkey % 4 = 0
UNION ALL SELECT year, month, flag, NULL, CASE WHEN hit THEN n ELSE 0 END FROM w WHERE o_orderkey % 4 = 1""")
def snapshot_by_month(spark, d):
    return N.state_by_month(_snapshot_tables(spark, d), "Aruba")


@query(f"""WITH {SNAPSHOT_SQL}, w AS (SELECT * FROM o WHERE year IS NULL OR year >= 1996)
SELECT year, month, flag, o_orderpriority AS institution, 'S' || (o_orderkey % 5) AS state, n AS total FROM w WHERE o_orderkey % 4 = 0 AND hit
UNION ALL SELECT year, month, flag, 'A & B', 'S9', 1001 FROM w WHERE o_orderkey % 4 = 0""")
def snapshot_schools_by_month(spark, d):
    return N.school_by_month(_snapshot_tables(spark, d), "aruba")


@query("""SELECT o_orderkey, r, CASE WHEN r = 0 THEN c WHEN r = 2 THEN 'aruba' ELSE 'Country of Citizenship' END AS country, 'absent' AS note FROM (
  SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'ARUBA' WHEN 1 THEN 'Aruba' ELSE 'Peru' END AS c FROM orders WHERE o_orderkey % 4 = 0), range(3) t(r)
UNION ALL SELECT o_orderkey, 0, NULL, 'absent' FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def rows_by_name(spark, d):
    pages = _html(spark, d)
    tables = P.main_table(P.extract_html_tables(pages))
    rows = N.named_rows(tables, ["Country of Citizenship", "Nowhere"], ["o_orderkey"])
    numbered = rows.select(
        "o_orderkey", F.col("Country of Citizenship").alias("country"), F.coalesce("Nowhere", F.lit("absent")).alias("note")
    )
    place = F.when(F.col("country") == "Country of Citizenship", 1).when(F.col("country") == "aruba", 2).otherwise(0)
    return numbered.select("o_orderkey", place.cast("bigint").alias("r"), "country", "note")


@query(f"""WITH {CAPTION_SQL}, links AS (SELECT DISTINCT caption AS url,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(month(o_orderdate) AS INTEGER) END AS month, o_orderstatus = 'F' AS flag FROM captions)
SELECT *, row_number() OVER (ORDER BY coalesce(year, 0), coalesce(month, 0), flag, url) AS place FROM links
WHERE year IS NULL OR year * 100 + month >= 199603""")
def link_places(spark, d):
    """Dated links in order, those of unknown month first."""
    year, month = T.caption_month("caption")
    captions = _captions(spark, d).select(
        F.col("caption").alias("url"), year.alias("year"), month.alias("month"), T.caption_flag("caption", "STEM").alias("flag")
    )
    rows = N.select_links(captions.distinct(), start="1996-03").withColumn("_at", F.monotonically_increasing_id())
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_at")).cast("bigint")).drop("_at")
