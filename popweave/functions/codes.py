"""Code tables: value classes, labels and derived flags."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, functions as F

from popweave.functions.numbers import ColumnOrName, as_col

Bins = list[tuple[str, float | None, float | None]]

# Attainment classes as (label, lowest code, highest code), for three published code lists.
ATTAINMENT_DETAILED: Bins = [
    ("< HS", None, 61),
    ("HS or GED", 62, 63),
    ("Some college", 64, 65),
    ("Associate", 100, 111),
    ("Bachelor's", 113, 113),
    ("Graduate", 114, None),
]
ATTAINMENT_SHORT: Bins = [
    ("< HS", None, 14),
    ("HS or GED", 15, 15),
    ("Some college", 16, 18),
    ("Associate", 19, 19),
    ("Bachelor's", 20, 20),
    ("Graduate", 21, None),
]
ATTAINMENT_PROFILE: Bins = [
    ("<HS", 1, 15),
    ("HS", 16, 16),
    ("Some/AA", 17, 21),
    ("BA", 22, 22),
    ("Grad+", 23, 25),
]
BACHELOR_PLUS = ["Bachelor's", "Graduate"]

# State codes and postal abbreviations.
STATE_CODES = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09", "DE": "10",
    "DC": "11", "FL": "12", "GA": "13", "HI": "15", "ID": "16", "IL": "17", "IN": "18", "IA": "19",
    "KS": "20", "KY": "21", "LA": "22", "ME": "23", "MD": "24", "MA": "25", "MI": "26", "MN": "27",
    "MS": "28", "MO": "29", "MT": "30", "NE": "31", "NV": "32", "NH": "33", "NJ": "34", "NM": "35",
    "NY": "36", "NC": "37", "ND": "38", "OH": "39", "OK": "40", "OR": "41", "PA": "42", "RI": "44",
    "SC": "45", "SD": "46", "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53",
    "WV": "54", "WI": "55", "WY": "56", "PR": "72",
}
# State names by code.
STATE_NAMES = {
    "01": "Alabama", "02": "Alaska", "04": "Arizona", "05": "Arkansas", "06": "California",
    "08": "Colorado", "09": "Connecticut", "10": "Delaware", "11": "District of Columbia",
    "12": "Florida", "13": "Georgia", "15": "Hawaii", "16": "Idaho", "17": "Illinois",
    "18": "Indiana", "19": "Iowa", "20": "Kansas", "21": "Kentucky", "22": "Louisiana",
    "23": "Maine", "24": "Maryland", "25": "Massachusetts", "26": "Michigan", "27": "Minnesota",
    "28": "Mississippi", "29": "Missouri", "30": "Montana", "31": "Nebraska", "32": "Nevada",
    "33": "New Hampshire", "34": "New Jersey", "35": "New Mexico", "36": "New York",
    "37": "North Carolina", "38": "North Dakota", "39": "Ohio", "40": "Oklahoma", "41": "Oregon",
    "42": "Pennsylvania", "44": "Rhode Island", "45": "South Carolina", "46": "South Dakota",
    "47": "Tennessee", "48": "Texas", "49": "Utah", "50": "Vermont", "51": "Virginia",
    "53": "Washington", "54": "West Virginia", "55": "Wisconsin", "56": "Wyoming",
}
# The name and figure tables cover states and the district only, not the territory.
STATE_POSTAL = {code: abbr for abbr, code in STATE_CODES.items() if code in STATE_NAMES}

# Race recode labels that are unambiguous.
RACE_LABELS = {"1": "White alone", "2": "Black alone", "6": "Asian alone", "8": "Some other race", "9": "Two or more races"}
# Nativity labels.
NATIVITY_LABELS = {"1": "U.S. native", "2": "Foreign-born"}
# Coverage labels.
COVERAGE_LABELS = {"1": "With coverage", "2": "No coverage", "1.0": "With coverage", "2.0": "No coverage"}
# Insurance indicators and their names.
INSURANCE_LABELS = {
    "HINS1": "Employer/Union",
    "HINS2": "Direct-Purchase",
    "HINS3": "Medicare",
    "HINS4": "Medicaid",
    "HINS5": "TRICARE",
    "HINS6": "VA",
    "HINS7": "Indian Health Service",
    "PRIVCOV": "Any Private",
    "PUBCOV": "Any Public",
}
# Occupation titles used where the code list gives none.
OCCUPATION_TITLES = {
    "311121": "Home health aides",
    "311131": "Nursing assistants",
    "291141": "Registered nurses",
    "434051": "Customer service representatives",
    "1191XX": "Other managers (misc.)",
    "412031": "Retail salespersons",
    "339030": "Security guards & related",
    "439061": "Office clerks, general",
    "132011": "Accountants & auditors",
    "412010": "Cashiers",
    "252020": "Elementary & middle school teachers",
    "151252": "Software developers",
    "411011": "First-line supervisors of retail sales",
    "533030": "Driver/sales workers & truck drivers",
    "311122": "Personal care aides",
}
# Fixed values: (state, county) pairs of the two study regions.
STUDY_COUNTIES = {
    "36": ["005", "047", "061", "081", "085"],
    "12": ["011", "086", "099"],
}


def bin_codes(code: Column, bins: Bins) -> Column:
    """Class of a numeric code: whole part within an inclusive range, later ranges win, NULL in the gaps."""
    code = F.when(code >= 0, F.floor(code)).otherwise(F.ceil(code))

    def inside(low, high) -> Column:
        return (F.lit(True) if low is None else code >= low) & (F.lit(True) if high is None else code <= high)

    # the last matching range wins, so it is asked first
    chain = reduce(
        lambda acc, b: acc.when(code.isNotNull() & inside(b[1], b[2]), F.lit(b[0])),
        list(reversed(bins))[1:],
        F.when(code.isNotNull() & inside(bins[-1][1], bins[-1][2]), F.lit(bins[-1][0])),
    )
    return chain.otherwise(F.lit(None).cast("string"))


def literal_map(table: dict[str, str]) -> Column:
    """A constant code list as a map; no join, nothing to broadcast. It is one literal, folded before the run."""
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


SEARCHED = 64  # codes from which on a list is searched by halving instead of from its front


def lookup(code: ColumnOrName, table: dict[str, str]) -> Column:
    """Label of a code, NULL when unknown. A list of n codes costs about log2(n) comparisons a row."""
    if not table:
        return F.lit(None).cast("string")
    code = as_col(code).cast("string")
    if len(table) < SEARCHED:
        return F.try_element_at(literal_map(table), code)
    ordered = sorted(table)  # by code point, which is how Spark orders text
    literal = lambda values: F.from_json(F.lit(json.dumps(values)), "array<string>")
    codes, labels = literal(ordered), literal([table[c] for c in ordered])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(ordered).bit_length()))])
    below = F.aggregate(
        steps, F.lit(0), lambda at, s: F.when(F.get(codes, at + s - 1) < code, at + s).otherwise(at)
    )
    found = F.struct(F.get(codes, below).alias("code"), F.get(labels, below).alias("label"))
    return F.get(F.transform(F.array(found), lambda f: F.when(f["code"] == code, f["label"])), F.lit(0))


def label(code: ColumnOrName, table: dict[str, str], width: int | None = None) -> Column:
    """Label of a code, the code itself when unknown."""
    from popweave.functions.text import zero_pad

    code = as_col(code).cast("string")
    return F.coalesce(lookup(zero_pad(code, width) if width else code, table), code)


def fallback_label(code: ColumnOrName, given: ColumnOrName, titles: dict[str, str]) -> Column:
    """The given label, unless it is missing or merely repeats the code; then the title list, then the label."""
    code, given = as_col(code).cast("string"), as_col(given)
    poor = given.isNull() | (F.trim(given) == F.trim(code))
    return F.when(poor, F.coalesce(lookup(F.trim(code), titles), given, code)).otherwise(given)


def override_label(code: ColumnOrName, given: ColumnOrName, titles: dict[str, str]) -> Column:
    """The title list first, then the given label, then the code."""
    code = as_col(code).cast("string")
    return F.coalesce(lookup(code, titles), as_col(given), code)


def state_codes(abbreviations: list[str]) -> list[str]:
    """Postal abbreviations to state codes; an unknown one is an error."""
    wanted = [a.strip().upper() for a in abbreviations if a.strip()]
    unknown = [a for a in wanted if a not in STATE_CODES]
    if unknown:
        raise KeyError(f"unknown state abbreviations: {unknown}")
    return [STATE_CODES[a] for a in wanted]


def state_code(abbreviation: ColumnOrName) -> Column:
    """Column form of ``state_codes``; the query fails on an unknown abbreviation."""
    abbr = F.upper(F.trim(as_col(abbreviation)))
    code = lookup(abbr, STATE_CODES)
    return F.when(abbr.isNull() | code.isNotNull(), code).otherwise(
        F.raise_error(F.concat(F.lit("unknown state abbreviation: "), abbr)).cast("string")
    )


def person_flags(age: Column, nativity: Column, labour: Column) -> dict[str, Column]:
    """Derived flags of a person; a missing code is never a yes."""

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return {
        "adult": F.coalesce(age, F.lit(0)) >= 16,
        "native": yes(nativity == 1),
        "foreign": yes(nativity == 2),
        "employed": yes(labour.isin(1, 2)),
        "unemployed": yes(labour == 3),
        "in_labour_force": yes(labour.isin(1, 2, 3)),
    }
