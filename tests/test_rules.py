"""The semantics contract, one small test per rule."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import rows
from popweave.functions import codes as C, numbers as N, predicates as P, text as T
from popweave.operators import joins as J, ranking as R, schema as S, weighted as W


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(F.col("i"), expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_unparseable_number_is_missing(spark):
    texts = [" 12 ", "1e3", "-4.5", "", "x", None, "NaN", "7.0", "1d", "2.5F", "inf", "0370"]
    assert column(spark, N.num, texts) == [12.0, 1000.0, -4.5, None, None, None, None, 7.0, None, None, float("inf"), 370.0]


def test_count_with_commas(spark):
    texts = ["1,234", "12,345,678", "7.9", "-3", "n/a", None, "inf", "1e400"]
    assert column(spark, N.count_int, texts) == [1234, 12345678, 7, -3, 0, 0, 0, 0]


def test_strict_and_lenient_sums(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0)], "a double, b double")
    out = df.select(N.strict_sum("a", "b"), N.lenient_sum(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in out] == [(3.0, 3.0), (None, 2.0)]


def test_sum_of_all_missing_is_zero_and_null_groups(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, 5)], "k string, w long")
    assert rows(W.weighted_count(df, ["k"], "w")) == [("a", 0), (None, 5)]
    assert rows(W.group_sum(df, ["k"], "w")) == [("a", 0)]
    with pytest.raises(ValueError):
        W.weighted_count(df, ["k"], "w", null_keys="maybe")


def test_missing_sorts_last_both_ways(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r.v for r in R.sort_rows(df, ["v"]).collect()] == [1, 2, None]
    assert [r.v for r in R.sort_rows(df, [("v", "desc")]).collect()] == [2, 1, None]


def test_directory_matches_unknown_year_and_latest(spark):
    facts = spark.createDataFrame([("u", 2020), ("u", None), ("v", 2020), ("w", 2021), ("x", 1)], "unitid string, year int")
    entries = spark.createDataFrame(
        [("u", 2020, "U20", "AA"), ("u", None, "U?", "BB"), ("v", 2018, "V18", None), ("v", 2019, "V19", "CC")],
        "unitid string, year int, instnm string, stabbr string",
    )
    fields = ["instnm", "stabbr"]
    assert rows(J.join_directory(facts, entries, "unitid", "year", fields)) == [
        ("u", 2020, "U20", "AA"), ("u", None, "U?", "BB"), ("v", 2020, "V19", "CC"), ("w", 2021, None, None), ("x", 1, None, None),
    ]
    # one row without an entry sends all to the latest, and an unknown year is the latest
    everything = J.join_directory(facts, entries, "unitid", "year", fields, fallback="all")
    assert rows(everything)[:2] == [("u", 2020, "U?", "BB"), ("u", None, "U?", "BB")]
    complete = J.join_directory(facts.where("unitid = 'u'"), entries, "unitid", "year", fields, fallback="all")
    assert rows(complete) == [("u", 2020, "U20", "AA"), ("u", None, "U?", "BB")]


def test_half_even(spark):
    assert column(spark, N.half_even, [0.5, 1.5, 2.5, -0.5, None, float("nan")], "double") == [0, 2, 2, 0, None, None]


def test_zero_pad_never_cuts(spark):
    assert column(spark, lambda c: T.zero_pad(c, 3), ["7", "1234", None, ""]) == ["007", "1234", None, "000"]


def test_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(N.safe_div("a", "b")).collect()] == [None, None, 2.0]
    cv = df.select(N.coefficient_of_variation("b", "a")).collect()
    assert cv[1][0] is None and cv[0][0] is None is not cv[2][0]


def test_code_match_by_value_or_text(spark):
    df = spark.createDataFrame([("0370", None), (None, "370"), ("370.0", "1"), ("37", "x"), (None, None)], "a string, b string")
    assert [bool(r[0]) for r in df.select(P.any_slot(["a", "b"], 370)).collect()] == [True, True, True, False, False]
    assert [bool(r[0]) for r in df.select(P.any_slot(["a", "b"], "370", as_string=True)).collect()] == [False, True, False, False, False]


def test_or_counts_once_slot_sum_counts_twice(spark):
    df = spark.createDataFrame([("7", "7", "o", 10), ("7", None, "o", 1), ("8", "9", "o", 100)], "a string, b string, s string, w long")
    assert df.where(P.any_slot(["a", "b"], 7)).agg(F.sum("w")).first()[0] == 11
    assert rows(W.tabulate_slots(df, "s", {}, "w", ["a", "b"], 7)) == [("o", 21)]


def test_share_is_taken_before_the_limit(spark):
    df = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1)], "k string, n long")
    top = R.top_n(W.share_of_total(df, "n"), [("n", "desc")], 1)
    assert [tuple(r) for r in top.collect()] == [("a", 6, 0.6)]


def test_median_is_lower_and_missing_income_counts_as_zero(spark):
    df = spark.createDataFrame([("g", 10.0, 1), ("g", 20.0, 1), ("h", None, 3), ("h", 5.0, 1), ("z", 4.0, 0)], "k string, x double, w long")
    assert rows(W.weighted_median(df, ["k"], "x", "w")) == [("g", 10.0), ("h", 5.0), ("z", 4.0)]
    assert rows(W.weighted_median(df, ["k"], "x", "w", null_as_zero=True)) == [("g", 10.0), ("h", 0.0), ("z", 4.0)]


def test_case_folding(spark):
    assert column(spark, lambda c: P.folded_equals(c, " peru"), ["PERU ", "Peru", "Per", None]) == [True, True, False, None]


def test_unknown_code_is_its_own_label(spark):
    assert column(spark, lambda c: C.label(c, C.STATE_NAMES, 2), ["1", "36", "72", None]) == ["Alabama", "New York", "72", None]


def test_unknown_month_passes_the_window(spark):
    df = spark.createDataFrame([(2023, 12), (2024, 1), (2024, 3), (None, 1), (2020, None), (0, 5)], "y int, m int")
    keep = [bool(r[0]) for r in df.select(P.year_month_between("y", "m", "2024-01", "2024-02")).collect()]
    assert keep == [False, True, False, True, True, True]


def test_gaps_of_the_detailed_list_have_no_class(spark):
    got = column(spark, lambda c: C.bin_codes(c, C.ATTAINMENT_DETAILED), [61.9, 62.0, 66.0, 99.0, 100.0, 111.0, 112.0, 113.0, 200.0, None], "double")
    assert got == ["< HS", "HS or GED", None, None, "Associate", "Associate", None, "Bachelor's", "Graduate", None]


def test_unknown_abbreviation_fails(spark):
    with pytest.raises(KeyError):
        C.state_codes(["NY", "XX"])
    assert C.state_codes([" ny", "FL", ""]) == ["36", "12"]
    df = spark.createDataFrame([("XX",)], "a string")
    with pytest.raises(PySparkException):
        df.select(C.state_code("a")).collect()


def test_filter_grammar(spark):
    df = spark.createDataFrame([("16", "1", "a"), ("99", "02", "b"), ("100", "1", "a"), ("x", "1", "a")], "age string, esr string, t string")
    assert rows(df.where(P.parse_filters({"age": "16:99", "esr": "1,2"})).select("age")) == [("16",), ("99",)]
    assert rows(df.where(P.parse_filters({"t": "b"})).select("age")) == [("99",)]
    assert df.where(P.parse_filters({})).count() == 4


def test_column_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["ZIP ", "Zip_Code", "Country"])
    assert S.pick_column(df, ["zip_code", "zip"]) == "Zip_Code"
    assert S.pick_column(df, ["nope"]) is None
    with pytest.raises(ValueError):
        S.pick_column(df, ["nope"], required=True)
    assert S.pick_column_regex(df, [r"\bCoC\b", r"\bCountry\b", "zip"]) == "Country"
    assert S.require_columns(df, ["nope"], on_missing="skip") is None
    with pytest.raises(ValueError):
        S.require_columns(df, ["nope"])


def test_code_lists_of_any_length(spark):
    table = {str(i): f"label {i}" for i in range(3000)}
    df = spark.createDataFrame([("7",), ("2999",), ("3000",), (None,)], "c string")
    assert rows(df.select("c", C.lookup("c", table))) == [("2999", "label 2999"), ("3000", None), ("7", "label 7"), (None, None)]


def test_links_are_resolved_as_urls_are(spark):
    from urllib.parse import urljoin

    page = "https://h.org/1/2/3/4/5/6/p.html?q#f"
    hrefs = ["../../../../../../a.csv", "../../../../../../../../x", "./././y", "a/../b/./c?d=../e", "/r/../s", "..", ".", "?z=1", "#g", "", "//o.org/x", "http://o.org/../y"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = {r.h: r.t for r in df.select("h", T.resolve_url("h", F.lit(page)).alias("t")).collect()}
    assert got == {h: urljoin(page, h) for h in hrefs}
    root = df.limit(1).select(T.resolve_url(F.lit("../../../../x"), F.lit("https://h.org/a"))).first()[0]
    assert root == "https://h.org/x"


def test_all_character_references(spark):
    import html

    texts = ["a &amp;lt; b", "&eacute;&Eacute;&nbsp;&#233;&#xE9;&#128;&hellip;", "no & reference &unknown;", "&copy 2020", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.unescape("t")).collect()] == [t and html.unescape(t) for t in texts]


def test_pivot_over_all_values(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", 3, 7), ("b", None, 9)], "k string, y int, v int")
    wide = W.pivot_sum(df, ["k"], "y", "v", row_total="all")
    assert wide.columns == ["k", "1", "2", "3", "all"]
    assert rows(wide) == [("a", 5, 1, 0, 6), ("b", 0, 0, 7, 7)]


def test_pivot_over_too_many_values_is_an_error(spark):
    df = spark.range(20).selectExpr("1 AS k", "id AS y", "id AS v")
    spark.conf.set("spark.sql.pivotMaxValues", "19")
    try:
        with pytest.raises(ValueError, match="more than 19 values"):
            W.pivot_sum(df, ["k"], "y", "v")
        assert len(W.pivot_sum(df.where("y < 19"), ["k"], "y", "v").columns) == 20
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_top_n_keeps_ties_deterministic_and_drops_null_groups(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "w"), (None, 9, "y"), ("b", None, "z")], "g string, n int, t string")
    assert rows(R.top_n_per_group(df, ["g"], [("n", "desc"), "t"], 1)) == [("a", 1, "w"), ("b", None, "z")]


def test_melt_keeps_missing(spark):
    df = spark.createDataFrame([(1, None, 5)], "id int, a int, b int")
    assert rows(S.melt(df, ["id"], ["a", "b"])) == [(1, "a", None), (1, "b", 5)]


def test_group_total_leaves_missing_keys_without_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 4.0)], "k string, v double")
    assert rows(R.with_group_total(df, ["k"], "v", "t")) == [("a", 1.0, 1.0), ("a", None, 1.0), (None, 4.0, None)]
