"""Files as they come: drifting headers, encodings, response pages, GeoJSON, web pages."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from helpers import rows
from popweave.functions import geometry as G, text as T
from popweave.operators import apportion as A
from popweave.plans import education as E, estimates as P, maps as Z, microdata as M, snapshots as N
from popweave.sinks import files as W
from popweave.sources import delimited as D, geojson as J, pages as H, responses as R


def put(folder, name, content, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content.encode(encoding))
    return str(folder)


def completions(folder):
    put(folder, "C2021_A.csv", "UNITID,CIPCODE,AWLEVEL,CTOTALT,MAJORNUM\n001,01.01,5,\"1,200\",1\n")
    put(folder, "c2022_a.csv", " awlevel ,ctotal_t,cipcode,unitid,major_num,CIPTITLE\n7,30,01.02,001,2,Études\n3,x,01.03,002,1,\n", "latin-1")
    put(folder, "C2023_A.csv", "UNITID,CIPCODE,AWLEVEL\n001,01.01,5\n")
    put(folder, "plain.csv", "UNITID,CIPCODE,AWLEVEL,CTOTALT\n003,02.01,5,4\n")
    return put(folder, "notes.txt", "UNITID,CIPCODE,AWLEVEL,CTOTALT\n9,9,9,9\n")


def test_drifting_files_align_by_name(spark, tmp_path):
    loaded = E.load_completions(spark, completions(tmp_path / "c"))
    assert rows(loaded) == [
        (2021, "001", "01.01", "1", "5", None, 1200),
        (2022, "001", "01.02", "2", "7", "Études", 30),
        (2022, "002", "01.03", "1", "3", None, 0),
        (None, "003", "02.01", None, "5", None, 4),
    ]


def test_completions_with_directory(spark, tmp_path):
    loaded = E.load_completions(spark, completions(tmp_path / "c"))
    put(tmp_path / "d", "hd2020.csv", "UNITID,INSTNM,STABBR\n001,Old One,NY\n002,Two,NJ\n")
    folder = put(tmp_path / "d", "HD2022.csv", "unitid,instnm,state_abbr\n001,New One,CT\n")
    directory = E.load_directory(spark, folder)
    assert directory.count() == 3
    named = E.completions_by_field(loaded, directory)
    assert named.columns == ["year", "unitid", "instnm", "stabbr", "cipcode", "ciptitle", "awlevel", "majornum", "ctotal"]
    assert [tuple(r) for r in named.select("year", "unitid", "instnm", "stabbr").collect()] == [
        (2021, "001", "New One", "CT"), (2022, "001", "New One", "CT"), (2022, "002", "Two", "NJ"), (None, "003", None, None),
    ]


def test_empty_folder_gives_an_empty_table(spark, tmp_path):
    folder = put(tmp_path / "e", "x.csv", "a,b\n1,2\n")
    assert E.load_completions(spark, folder).count() == 0
    assert D.scan_drifting_csv(spark, folder, required=[["zz"]]) is None


def test_utf8_is_judged_by_the_whole_file(spark, tmp_path):
    body = "name\n" + "plain\n" * 500 + "café\n"
    put(tmp_path / "u", "a.csv", body, "latin-1")
    folder = put(tmp_path / "u", "b.csv", body, "utf-8")
    found = D.scan_drifting_csv(spark, folder).where("name <> 'plain'")
    assert rows(found.select("name", "source_file")) == [("café", "a.csv"), ("café", "b.csv")]


def test_csv_keeps_zeros_and_quotes(spark, tmp_path):
    folder = put(tmp_path / "q", "p_a.csv", 'id,name\n007,"a ""b"", c"\n')
    put(tmp_path / "q", "other.csv", "id,name\n1,x\n")
    read = D.scan_csv(spark, folder, glob="p_*.csv")
    assert rows(read) == [("007", 'a "b", c')]
    again = D.scan_csv(spark, W.write_csv(read, str(tmp_path / "out")))
    assert rows(again) == [("007", 'a "b", c')]


def test_response_pages(spark, tmp_path):
    put(tmp_path / "r", "1.json", json.dumps([["NAME", "E", "M", "state"], ["Alabama", "144", 18, "01"], ["X", None, "bad", "72"]]))
    put(tmp_path / "r", "2.json", json.dumps([["state", "E", "NAME"], ["36", "7", "New York"]]))
    folder = put(tmp_path / "r", "3.json", json.dumps([["NAME", "E", "M", "state"]]))
    put(tmp_path / "r", "4.json", "[]")
    got = R.scan_header_json(spark, folder, ["NAME", "E", "M", "state"])
    assert rows(got) == [("Alabama", "144", "18", "01"), ("New York", "7", None, "36"), ("X", None, "bad", "72")]
    table = P.state_estimates(got, ["E", "M"])
    assert rows(table.select("state_fips", "total", "state_name")) == [
        ("01", 162.0, "Alabama"), ("36", None, "New York"), ("72", None, "72"),
    ]


def test_code_list(spark, tmp_path):
    folder = put(tmp_path / "l", "v.json", json.dumps({"name": "V", "values": {"1": "Yes", "2": {"label": "No", "x": 1}, "3": {"y": 2}}}))
    assert rows(R.scan_code_list(spark, folder)) == [("1", "Yes"), ("2", "No"), ("3", '{"y":2}')]


def feature(i, kind, coordinates, **more):
    return {"type": "Feature", "properties": {"GEOID10": i, **more}, "geometry": {"type": kind, "coordinates": coordinates}}


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    hole = [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 1], [0.5, 0.5]]
    far = [[[5, 5, 1], [6, 5, 1], [6, 6, 1], [5, 5, 1]]]
    doc = {"type": "FeatureCollection", "features": [
        feature("1", "Polygon", [square, hole], n=3), feature("22222", "MultiPolygon", [[square], far]), feature("3", "Point", [1, 2]),
    ]}
    folder = put(tmp_path / "g", "a.geojson", json.dumps(doc, indent=1))
    read = J.feature_ids(J.scan_geojson(spark, folder), ["ZCTA5CE20", "GEOID10"], "zip", 5)
    assert rows(read.select("zip", G.area("geom"))) == [("00001", 3.75), ("00003", None), ("22222", 4.5)]
    path = W.write_geojson(read.where("geom is not null").select("zip", "geom"), str(tmp_path / "lines"))
    again = J.feature_ids(J.scan_geojson(spark, path, layout="feature_lines"), ["zip"], "zip")
    assert rows(again.select("zip", G.area("geom"))) == [("00001", 3.75), ("22222", 4.5)]
    line = spark.read.text(path).first()[0]
    assert json.loads(line)["type"] == "Feature" and json.loads(line)["geometry"]["type"] == "MultiPolygon"
    with pytest.raises(ValueError):
        J.scan_geojson(spark, folder, layout="other")


PAGE = """<html><body><TABLE><tr><td>nav</td></tr></TABLE>
<table id=t><thead><tr><th colspan=2>Country of<br>Citizenship</th><th>Count</th></tr></thead>
<tfoot><tr><td>Total</td><td></td><td>9</td></tr></tfoot>
<tbody><tr><td rowspan="2">Peru</td><td>a &amp; b</td><td> 1,234
</td></tr><tr><td>c</td><td>5<table><tr><td>in</td></tr></table></td></tr>
<tr style="display: none"><td>x</td><td>y</td><td>z</td></tr><tr><td>short</td></tr></tbody></table>
<table></table><table><tr><td> </td></tr></table></body></html>"""


def test_table_extraction():
    assert H._read_tables(PAGE) == [
        [["nav"]],
        [
            ["Country of Citizenship", "Country of Citizenship", "Count"],
            ["Peru", "a & b", "1,234"],
            ["Peru", "c", "5in"],
            ["short", None, None],
            ["Total", None, "9"],
        ],
        [["in"]],
    ]
    assert H._read_tables(None) == [] and H._read_tables("<p>none</p>") == []
    assert H._read_tables("<table><tr><td>open<td>end") == [[["open", "end"]]]


def page_frame(spark, *pages):
    return spark.createDataFrame([(f"https://d.example.org/t/{i}", h) for i, h in enumerate(pages)], "url string, html string")


def test_main_table_and_cleaning(spark):
    repeat = "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>B </td><td>A</td></tr><tr><td></td><td></td></tr></table>"
    bare = "<table><tr><td>12</td><td>x</td><td>y</td></tr></table>"
    link = "<a data-csv-url='/f.csv?x=1&amp;y=2'>"
    cleaned = N.page_table(page_frame(spark, repeat, bare, link, "<p>", PAGE)).orderBy("url").collect()
    assert [(r.source, r.header, len(r.rows or [])) for r in cleaned] == [
        ("table", ["A", "B"], 1), ("headerless", ["0", "1", "2"], 1), ("csv_link", None, 0), (None, None, 0),
        ("table", ["Country of Citizenship", "Country of Citizenship", "Count"], 4),
    ]


def test_snapshots(spark):
    base = "https://d.example.org"
    index = spark.createDataFrame([(1, """
      <a class="x" href="/tool/march-2024-stem-data">March 2024 <b>STEM</b> Data</a>
      <a href="/tool/march-2024-data">March 2024 Data</a> <a href="/about">About</a>
      <a href="/tool/march-2024-data">again</a><a href="tool/undated-data">systems Data</a>
      <a href="https://d.example.org/tool/may-2020-data">MAY 2020 x</a>""")], "page_id long, html string")
    links = H.link_catalogue(index, base, "STEM", contains="tool", ends="-data")
    assert [tuple(r) for r in N.select_links(links).collect()] == [
        (f"{base}/tool/undated-data", "systems Data", None, None, False),
        (f"{base}/tool/may-2020-data", "MAY 2020 x", 2020, 5, False),
        (f"{base}/tool/march-2024-data", "March 2024 Data", 2024, 3, False),
        (f"{base}/tool/march-2024-stem-data", "March 2024 STEM Data", 2024, 3, True),
    ]
    assert [r.url[-12:] for r in N.select_links(links, flag=False, start="2021-01").collect()] == ["undated-data", "ch-2024-data"]
    with_state = "<table><tr><th>CoC</th><th>State</th><th>School</th><th>Active Students</th></tr>{}</table>"
    body = "".join(f"<tr><td>{c}</td><td>{s}</td><td>{u}</td><td>{n}</td></tr>" for c, s, u, n in [
        ("Peru", "NY", "U1", "1,000"), ("PERU", "NY", "U2", "5"), ("Peru", "", "U3", "7"), ("Chile", "NY", "U1", "9"), ("Peru", "CT", "", "x")])
    plain = "<table><tr><td>Country of Citizenship</td><td>Count</td></tr><tr><td>peru</td><td>3</td></tr><tr><td>Peru</td><td>4</td></tr></table>"
    none = "<table><tr><th>Planet</th><th>Count</th></tr><tr><td>Peru</td><td>3</td></tr></table>"
    pages = spark.createDataFrame([
        (f"{base}/tool/march-2024-stem-data", with_state.format(body)), (f"{base}/tool/march-2024-data", plain),
        (f"{base}/tool/undated-data", none), ("https://elsewhere", plain)], "url string, html string")
    tables = N.snapshot_tables(N.select_links(links), pages, tag="stem", page_suffix="-data").cache()
    assert {r.slug for r in tables.collect()} == {"2024-03-stem", "2024-03", "undated"}
    assert [tuple(r) for r in N.state_by_month(tables, "Peru").collect()] == [
        (2024, 3, True, "CT", 0), (2024, 3, True, "NY", 1005), (2024, 3, False, None, 7),
    ]
    assert [tuple(r) for r in N.school_by_month(tables, "peru").collect()] == [
        (2024, 3, True, "U1", "NY", 1000), (2024, 3, True, "U2", "NY", 5),
    ]
    assert [tuple(r) for r in N.state_by_month(tables, "Nowhere").collect()] == [(2024, 3, False, None, 0)]
    names = sorted({n for r in tables.collect() for n in r["header"] or [] if n})
    assert names == ["Active Students", "CoC", "Count", "Country of Citizenship", "Planet", "School", "State"]
    wide = N.named_rows(tables, names, ["year", "month", "flag"])
    assert wide.count() == 5 + 2 + 1 and wide.where("CoC = 'Chile' and Planet is null").count() == 1


@pytest.mark.parametrize("page", ["http://a.org/x/y/z.html?q=1#f", "https://a.org", "http://a.org/x/y/", "http://a.org/x/y"])
def test_links_resolve_like_a_browser(spark, page):
    hrefs = ["/r/s", "t.csv", "./t.csv", "../t.csv", "../../u/v.csv", "//b.org/w", "https://c.org/d", "?p=2", "a/b/../c", "mailto:x@y"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string")
    got = [r[0] for r in df.orderBy("i").select(T.resolve_url("h", F.lit(page))).collect()]
    expected = [urljoin(page, h) for h in hrefs]
    # one step above the top of a site has no agreed meaning
    assert [g for g, h in zip(got, hrefs) if not h.startswith("../")] == [e for e, h in zip(expected, hrefs) if not h.startswith("../")]
    if page.count("/") > 4:
        assert got == expected


# --- jobs on saved tables ---------------------------------------------------------------------------------------


def test_country_table_end_to_end(spark, tmp_path):
    folder = put(tmp_path / "od", "o.csv", "academic_year, Institution,State,Total,place_of_origin\n"
                 "2025,Alpha College,NY,12, Peru \n2025,Beta College,CT,bad,PERU\n2024,Alpha College,NY,3,peru\n"
                 "2025,,NY,99,Peru\n2025,Gamma,,5,Peru\n2025,Alpha College,NY,1,Chile\n")
    table = E.country_table(D.scan_csv(spark, folder), "peru")
    assert rows(table) == [
        (2024, "Alpha College", "NY", 3), (2025, "Alpha College", "NY", 12), (2025, "Beta College", "CT", 0), (2025, "Gamma", None, 5),
    ]
    by_state = E.country_by_state(table)
    assert [tuple(r) for r in by_state.collect()] == [(2024, "NY", 3), (2025, "CT", 0), (2025, "NY", 12)]
    assert [tuple(r) for r in E.country_state_pivot(by_state, [2024, 2025]).collect()] == [("CT", 0, 0), ("NY", 3, 12)]


def test_snapshot_without_a_state_column_gives_a_total(spark):
    raw = spark.createDataFrame([("Peru", "U", "1,000"), ("PERU", "V", "2"), ("Chile", "U", "5")], ["CoC", "School Name", "Count"])
    found = E.snapshot_summary(raw, "peru")
    assert rows(found["state"]) == [(1002,)]
    assert rows(found["school"]) == [("U", 1000), ("V", 2)]
    with pytest.raises(ValueError):
        E.snapshot_summary(raw.drop("Count"), "peru")


def test_extract_tolerates_missing_columns(spark):
    raw = spark.createDataFrame([("0370", None, "5", "6"), (None, "370", "x", "36"), ("1", "2", "3", "6")], ["ANC1P", "ANC2P", "PWGTP", "STATE"])
    out = M.extract_population(raw, 370)
    assert out.columns == ["STATE", "PWGTP", "ANC1P", "ANC2P"]
    assert rows(out) == [("06", 5, "0370", None), ("36", None, None, "370")]
    assert set(M.population_tables(out)) == {"state"}
    with pytest.raises(ValueError):
        M.extract_population(raw.drop("ANC2P"), 370)


def test_attainment_rolls_up(spark):
    data = [(s, n, c, w) for s, n, c, w in [("6", 1, 20, 5), ("6", 2, 21, 7), ("36", 1, 14, 11), ("36", 2, None, 100), (None, 1, 20, 13)]]
    persons = E.with_attainment(spark.createDataFrame(data, "STATEFIP string, NATIVITY int, SCHL int, PWGTP long"))
    national = {r[0]: r[1] for r in E.attainment(persons).collect()}
    assert national == {"Bachelor's": 18, "Graduate": 7, "< HS": 11}
    parts = E.attainment(persons, ["NATIVITY"]).groupBy("attain_bin").agg(F.sum("weighted_count")).collect()
    assert {r[0]: r[1] for r in parts} == national
    assert rows(E.attainment_by_state(persons)) == [("06", "Bachelor's", 5), ("06", "Graduate", 7), ("36", "< HS", 11)]
    assert rows(E.bachelor_by_nativity(persons)) == [(1, 18, 0, 18), (2, 0, 7, 7)]


def test_zip_estimates_by_published_and_short_keys(spark):
    stats = spark.createDataFrame([("36005000100", "10", "3"), ("36005000200", "20", "4"), ("12011000100", "7", None)], "geoid string, estimate string, moe string")
    raw = spark.createDataFrame([("601", "36005000100", "0.25"), ("10001", "36005000100", "0.75"), ("10001", "36005000200", "1"), ("99999", "1", "bad")],
                                ["ZIP", "Tract", "RES_RATIO"])
    xwalk = A.load_crosswalk(raw)
    assert A.crosswalk_key(xwalk) == 11
    out = Z.estimates_by_zip(A.read_area_stats(stats), xwalk)
    assert rows(out) == [("00601", 2, 1), ("10001", 28, 5)]
    short = A.load_crosswalk(spark.createDataFrame([("10001", "000100", "1")], ["zcta5", "geotract", "ratio"]))
    assert A.crosswalk_key(short) == 6
    with pytest.warns(UserWarning):
        both = Z.estimates_by_zip(A.read_area_stats(stats), short)
    assert rows(both) == [("10001", 17, 3)]
    nested = A.load_nested_crosswalk(spark.createDataFrame([("36005000100", "BX01"), ("36005000200", "BX01")], ["GEOID", "NTACode"]))
    assert rows(Z.estimates_by_neighbourhood(A.read_area_stats(stats), nested)) == [("BX01", 30, 5)]
    with pytest.raises(ValueError):
        A.load_crosswalk(spark.createDataFrame([(1,)], ["zip"]))
    with pytest.raises(ValueError):
        Z.estimates_by_zip(stats)


def test_dashboard_with_state_choice_and_names(spark):
    data = [("6", "101", "0370", None, 10, 1, 1, 22, 30, 1000.0), ("6", "101", None, "370", 5, 2, 3, 16, 15, None),
            ("6", "102", "370", "370", 3, 1, 6, 24, 70, 5.0), ("36", "7", "370", None, 2, 2, 2, 1, 40, 8.0), ("6", "101", "1", "2", 99, 1, 1, 22, 30, 1.0)]
    persons = spark.createDataFrame(data, "STATE string, PUMA string, ANC1P string, ANC2P string, PWGTP long, NATIVITY int, ESR int, SCHL int, AGEP int, PINCP double")
    table = spark.createDataFrame([("6", "50"), ("36", "n/a"), ("12", "7")], "state string, total string")
    names = spark.createDataFrame([("00101", "Old Town")], "PUMA_CODE string, puma_name string")
    wide = M.area_dashboard(persons, 370, M.largest_states(table, "total", 1), names)
    got = {r["PUMA"]: r.asDict() for r in wide.collect()}
    assert set(got) == {"101", "102"}
    first = got["101"]
    assert (first["pop"], first["native"], first["foreign"], first["edu_ba"], first["edu_hs"]) == (15, 10, 5, 10, 5)
    assert first["income_mean"] == pytest.approx(10000 / 15) and first["income_median"] == 1000.0
    # the unemployed person is under sixteen
    assert first["employment_rate"] == 1.0 and first["puma_name"] == "Old Town"
    assert got["102"]["employment_rate"] is None and got["102"]["puma_name"] is None and got["102"]["pct_edu_grad_plus"] == 1.0


def test_emptiness_gate(spark):
    from popweave.operators.weighted import has_rows

    assert has_rows(spark.range(1)) and not has_rows(spark.range(0))


def test_figure_tables(spark):
    counts = spark.createDataFrame([("36", 90), ("6", 40), ("72", 1)], "STATE string, weighted_count long")
    assert [tuple(r) for r in P.top_states(counts, 2).collect()] == [("36", 90, "NY"), ("6", 40, "CA")]
    ancestry = spark.createDataFrame([("36", "200"), ("6", "30"), ("72", None)], "state_fips string, ancestry string")
    born = spark.createDataFrame([("36", "100"), ("06", "0"), ("72", "5")], "state_fips string, born string")
    table = P.visibility_table(ancestry, born, counts)
    assert rows(table.select("state", "ratio", F.round("size", 3))) == [
        ("72", None, 28.433), ("CA", None, 73.333), ("NY", 2.0, 100.0),
    ]
    assert [r["state"] for r in P.visibility_ratios(table).collect()] == ["NY"]
    assert [r["state"] for r in P.dense_cluster(table, 50).collect()] == ["CA"]


def test_blank_lines_before_the_header(spark, tmp_path):
    put(tmp_path / "blank", "a1999.csv", "id,x\n1,2\n")
    folder = put(tmp_path / "blank", "b2000.csv", "\n  \nid,y\n3,4\n")
    found = D.scan_drifting_csv(spark, folder)
    assert rows(found.select("id", "x", "y", "year")) == [("1", "2", None, 1999), ("3", None, "4", 2000)]


def test_spelling_counts_for_the_whole_file(spark, tmp_path):
    put(tmp_path / "both", "c2001.csv", "UNITID,CIPCODE,AWLEVEL,CTOTALT,CTOTAL_T\n1,01.0,5,,9\n2,01.0,5,3,9\n")
    folder = put(tmp_path / "both", "c2002.csv", "unitid,cipcode,awlevel, ctotal_t\n1,01.0,5,8\n")
    got = E.load_completions(spark, folder)
    assert rows(got.select("year", "unitid", "ctotal")) == [(2001, "1", 0), (2001, "2", 3), (2002, "1", 8)]


def test_columns_of_all_response_pages(spark, tmp_path):
    put(tmp_path / "pages", "1.json", json.dumps([["A", "B"], ["1", "2"]]))
    folder = put(tmp_path / "pages", "2.json", json.dumps([["A", "B", "C"], ["3", "4", "5"]] + [["x" * 500, "", ""]]))
    got = R.scan_header_json(spark, folder)
    assert got.columns == ["A", "B", "C"] and rows(got.where("length(A) = 1")) == [("1", "2", None), ("3", "4", "5")]


def test_polygons_in_a_geometry_collection(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    members = [{"type": "Point", "coordinates": [1, 1]}, {"type": "Polygon", "coordinates": [square]}, {"type": "MultiPolygon", "coordinates": [[[[5, 5], [6, 5], [6, 6], [5, 5]]]]}]
    shape = {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": members}}
    folder = put(tmp_path / "gc", "a.geojson", json.dumps({"type": "FeatureCollection", "features": [shape]}))
    assert rows(J.scan_geojson(spark, folder).select(G.area("geom"))) == [(4.5,)]


def test_a_page_that_landed_twice_counts_once(spark):
    html = "<table><tr><th>Country of Citizenship</th><th>State</th><th>Active Students</th></tr><tr><td>Peru</td><td>NY</td><td>5</td></tr></table>"
    links = spark.createDataFrame([("u", "t", 2024, 3, False)], "url string, text string, year int, month int, flag boolean")
    pages = spark.createDataFrame([("u", html), ("u", html)], "url string, html string")
    tables = N.snapshot_tables(links, pages)
    assert [r.total for r in N.state_by_month(tables, "Peru").collect()] == [5]


def test_anchors_in_any_quotes(spark):
    html = "<A class='x' HREF='a b'>one</a><a href=two>2</a ><a data-href=\"no\">x</a><a\nid=q href = \"c>d\" title='t'><b>three</b></a><a href=''>e</a>"
    df = spark.createDataFrame([(1, html)], "i int, html string")
    assert rows(H.extract_links(df, ["i"])) == [(1, 0, "a b", "one"), (1, 1, "two", "2"), (1, 2, "c>d", "three")]
