"""Attainment, fields of degree, completions and country-of-origin tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popweave.functions.codes import ATTAINMENT_DETAILED, ATTAINMENT_SHORT, BACHELOR_PLUS, Bins, bin_codes
from popweave.functions.numbers import count_int, num, number
from popweave.functions.predicates import drop_missing, folded_equals, in_codes, in_range
from popweave.functions.text import zero_pad
from popweave.operators.joins import join_directory, lookup_join
from popweave.operators.ranking import sort_rows, top_n, top_n_per_group
from popweave.operators.schema import conform, melt, pick_column, pick_column_regex, tidy
from popweave.operators.weighted import group_sum, measure, pivot_sum, row_sum_by_prefix, sum_or_total
from popweave.sources.delimited import scan_drifting_csv

# Header patterns of the monthly snapshots, in order of preference.
COUNTRY_PATTERNS = [r"\bCoC\b", r"Country of Citizenship", r"\bCountry\b"]
STATE_PATTERNS = [r"\bStateAbbrv\b", r"\bState\b", r"U\.?S\.?\s*State"]
SCHOOL_PATTERNS = [r"\bU\.?S\.?\s*School\b", r"\bSchool Name\b", r"\bSchool\b"]
COUNT_PATTERNS = [r"Count of Active STEM Students", r"Active Students", r"\bCount\b"]


def with_attainment(persons: DataFrame, bins: Bins | None = None, code: str | None = None) -> DataFrame:
    """Add ``attain_bin``; the detailed code is used if there is one, else the short one."""
    code = code or ("EDUCD" if "EDUCD" in persons.columns else "SCHL")
    bins = bins or (ATTAINMENT_DETAILED if code == "EDUCD" else ATTAINMENT_SHORT)
    return persons.withColumn("attain_bin", bin_codes(number(persons, code), bins))


def attainment(persons: DataFrame, by: list[str] | None = None, weight: str = "PWGTP") -> DataFrame:
    """Weighted count per attainment class, within other keys if given; unclassified persons are left out."""
    by = by or []
    counts = group_sum(persons, [*by, "attain_bin"], weight, "weighted_count")
    return sort_rows(counts, [*by, ("weighted_count", "desc"), "attain_bin"])


def attainment_by_state(persons: DataFrame, state: str = "STATEFIP", weight: str = "PWGTP") -> DataFrame:
    return attainment(persons.withColumn(state, zero_pad(state, 2)), [state], weight)


def top_bachelor_states(persons: DataFrame, state: str = "STATE", weight: str = "PWGTP", n: int = 12) -> DataFrame:
    rows = persons.where(in_codes("attain_bin", BACHELOR_PLUS))
    return top_n(group_sum(rows, [state], weight, "weighted_count"), [("weighted_count", "desc"), state], n)


def bachelor_by_nativity(persons: DataFrame, nativity: str = "NATIVITY", weight: str = "PWGTP") -> DataFrame:
    """Bachelor's, graduate and their total, one row per nativity."""
    rows = persons.where(in_codes("attain_bin", BACHELOR_PLUS))
    return pivot_sum(rows, [nativity], "attain_bin", weight, BACHELOR_PLUS, row_total="BA+")


def top_fields_of_degree(
    persons: DataFrame, slots: list[str] = ["FOD1P", "FOD2P"], weight: str = "PWGTP", n: int = 15, low: int = 1100, high: int = 6199
) -> DataFrame:
    """Largest fields of degree of persons with a bachelor's or more; each of a person's fields counts."""
    slots = [c for c in slots if c in persons.columns]
    if not slots:
        raise ValueError("no field-of-degree column")
    rows = persons.where(in_codes("attain_bin", BACHELOR_PLUS))
    rows = rows.select(measure(rows, weight).alias(weight), *[number(rows, c).alias(c) for c in slots])
    long = melt(rows, [weight], slots, "which", "FODP").where(in_range("FODP", low, high))
    counts = group_sum(long, ["FODP"], weight, "weighted_count")
    return top_n(counts, [("weighted_count", "desc"), "FODP"], n)


def completions_with_state(
    completions: DataFrame,
    directory: DataFrame,
    prefixes: list[str] = ["CTOTAL", "CIP", "AWARD"],
    exclude: list[str] | None = None,
) -> DataFrame:
    """Completions rows with their total over all count columns, and the institution's state and name.

    ``CIPCODE`` and ``CIPTITLE`` start like count columns but are codes, and are left out unless ``exclude`` says otherwise.
    """
    exclude = ["CIPCODE", "CIPTITLE"] if exclude is None else exclude
    unit = pick_column(completions, ["UNITID"], required=True)
    unit_h = pick_column(directory, ["UNITID"], required=True)
    state = pick_column(directory, ["STABBR", "STATE"], required=True)
    name = pick_column(directory, ["INSTNM", "NAME"], required=True)
    totals = row_sum_by_prefix(completions, prefixes, "total_completions", exclude).withColumnRenamed(unit, "UNITID")
    slim = directory.select(F.col(unit_h).alias("UNITID"), F.col(state).alias("STATE"), F.col(name).alias("INSTNM"))
    totals = totals.drop(*[c for c in ("STATE", "INSTNM") if c in totals.columns])
    return lookup_join(totals, slim, ["UNITID"])


def completions_by_state(rows: DataFrame) -> DataFrame:
    return sort_rows(group_sum(rows, ["STATE"], "total_completions"), [("total_completions", "desc"), "STATE"])


def top_completions(rows: DataFrame, n: int = 10, ties: list[str] = ["INSTNM"], merge: bool = False) -> DataFrame:
    """Largest completion rows of each state; with ``merge`` the largest institutions instead."""
    if merge:
        rows = group_sum(rows, ["STATE", "INSTNM"], "total_completions")
        ties = ["INSTNM"]
    top = top_n_per_group(rows, ["STATE"], [("total_completions", "desc"), *ties], n)
    return top.select("STATE", "INSTNM", "total_completions")


def country_table(
    raw: DataFrame,
    country: str,
    country_field: str = "place_of_origin",
    institution_field: str = "institution",
    state_field: str = "state",
    year_field: str = "academic_year",
    count_field: str = "total",
    count: str = "students",
) -> DataFrame:
    """Tidy (year, instnm, stabbr, count) rows of one country; an absent state column is NULL, nameless rows are dropped."""
    origin = pick_column(raw, [country_field], required=True)
    rows = tidy(
        raw.where(folded_equals(F.col(f"`{origin}`"), country)),
        {"year": year_field, "instnm": institution_field, "stabbr": state_field, count: count_field},
    )
    typed = rows.withColumns(
        {
            "year": num(F.col("year").cast("string")).try_cast("int"),
            count: F.coalesce(num(F.col(count).cast("string")).try_cast("bigint"), F.lit(0).cast("bigint")),
        }
    )
    return drop_missing(typed, ["instnm"])


def country_by_state(table: DataFrame, count: str = "students") -> DataFrame:
    return sort_rows(group_sum(table, ["year", "stabbr"], count), ["year", "stabbr"])


def country_state_pivot(by_state: DataFrame, years: list[int] | None = None, count: str = "students") -> DataFrame:
    """One row per state, one column per year, or per listed year, missing as 0."""
    return sort_rows(pivot_sum(by_state, ["stabbr"], "year", count, years), ["stabbr"])


def load_completions(spark: SparkSession, path: str) -> DataFrame:
    """Tidy rows of all yearly completions files in a folder; files without the needed columns are skipped."""
    schema = {
        "year": "int", "unitid": "string", "cipcode": "string", "majornum": "string",
        "awlevel": "string", "ciptitle": "string", "ctotal": "bigint",
    }
    # a file has one of two spellings, or both and then the first counts
    spellings = {"ctotal": ["ctotalt", "ctotal_t"], "majornum": ["majornum", "major_num"]}
    required = [["unitid"], ["cipcode"], ["awlevel"], spellings["ctotal"]]
    rows = scan_drifting_csv(spark, path, required=required, spellings=spellings)
    if rows is None:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in schema.items()))
    return conform(rows.withColumn("ctotal", count_int("ctotal")), schema)


def load_directory(spark: SparkSession, path: str) -> DataFrame:
    """(year, unitid, instnm, stabbr) of all yearly directory files in a folder."""
    schema = {"year": "int", "unitid": "string", "instnm": "string", "stabbr": "string"}
    rows = scan_drifting_csv(
        spark, path, required=[["unitid"], ["instnm"]], spellings={"stabbr": ["stabbr", "state_abbr"]}
    )
    if rows is None:
        return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in schema.items()))
    return conform(rows, schema)


COMPLETION_COLUMNS = {
    "year": "int", "unitid": "string", "instnm": "string", "stabbr": "string", "cipcode": "string",
    "ciptitle": "string", "awlevel": "string", "majornum": "string", "ctotal": "bigint",
}


def completions_by_field(completions: DataFrame, directory: DataFrame | None = None, fallback: str = "row") -> DataFrame:
    """Completions with the institution's name and state of the same year, else of the latest; sorted, fixed columns."""
    rows = completions
    if directory is not None:
        rows = join_directory(rows, directory, "unitid", "year", ["instnm", "stabbr"], fallback)
    return sort_rows(conform(rows, COMPLETION_COLUMNS), ["year", "unitid", "cipcode", "awlevel", "majornum"])


def snapshot_summary(raw: DataFrame, country: str) -> dict[str, DataFrame]:
    """State and, if there is a school column, school sums of one country in one snapshot, whatever its header."""
    found = {n: pick_column_regex(raw, p) for n, p in (
        ("country", COUNTRY_PATTERNS), ("state", STATE_PATTERNS), ("institution", SCHOOL_PATTERNS), ("total", COUNT_PATTERNS),
    )}
    if not found["country"] or not found["total"]:
        raise ValueError(f"no country or count column in {raw.columns}")
    rows = raw.where(folded_equals(F.col(f"`{found['country']}`"), country))
    named = rows.select(
        *[F.col(f"`{found[n]}`").alias(n) for n in ("institution", "state") if found[n]],
        count_int(F.col(f"`{found['total']}`").cast("string")).alias("total"),
    )
    state = "state" if found["state"] else None
    tables = {"state": sum_or_total(named, [state], "total", "total")}
    if found["institution"]:
        tables["school"] = sum_or_total(named, ["institution", state], "total", "total")
    return tables
