"""Sub-population extracts and weighted tables of person records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popweave.functions.codes import (
    COVERAGE_LABELS,
    INSURANCE_LABELS,
    OCCUPATION_TITLES,
    STATE_NAMES,
    fallback_label,
    label,
    lookup,
    override_label,
)
from popweave.functions.numbers import num, safe_div
from popweave.functions.predicates import any_slot, parse_filters
from popweave.functions.text import zero_pad
from popweave.operators.joins import keep_members, lookup_join
from popweave.operators.ranking import sort_rows, top_n
from popweave.operators.schema import keep_columns, require_columns, rename_alternates
from popweave.operators.weighted import (
    group_profile,
    indicator_mix,
    share_of_total,
    tabulate_slots,
    weighted_count,
)

# Columns an extract keeps, and those of them that are numbers.
EXTRACT_COLUMNS = [
    "STATE", "PUMA", "PWGTP", "AGEP", "SEX", "RAC1P", "HISP", "NATIVITY", "ANC1P", "ANC2P", "SCHL", "ESR", "PINCP",
]
NUMERIC_COLUMNS = ["PWGTP", "AGEP", "RAC1P", "HISP", "NATIVITY", "SCHL", "ESR", "PINCP"]
SLOTS = ["ANC1P", "ANC2P"]


def extract_population(
    raw: DataFrame, code, slots: list[str] = SLOTS, keep: list[str] = EXTRACT_COLUMNS, numeric: list[str] = NUMERIC_COLUMNS
) -> DataFrame:
    """Records with the code in any slot, the kept columns only, typed. The filter runs in the scan's own stage."""
    require_columns(raw, [*slots, "PWGTP"])
    rows = keep_columns(raw.where(any_slot(slots, code)), keep)
    whole = {"PWGTP", "AGEP", "RAC1P", "HISP", "NATIVITY", "SCHL", "ESR"}
    typed = {c: num(F.col(c).cast("string")).try_cast("bigint" if c in whole else "double") for c in numeric if c in rows.columns}
    rows = rows.withColumns(typed)
    return rows.withColumn("STATE", zero_pad("STATE", 2)) if "STATE" in rows.columns else rows


def counts_by_state(persons: DataFrame, names: dict[str, str] = STATE_NAMES) -> DataFrame:
    """Weighted count per state, with the name; persons without a state form a group."""
    counts = weighted_count(persons, ["STATE"], "PWGTP")
    return sort_rows(counts.withColumn("state_name", label("STATE", names, width=2)), ["STATE"])


def counts_by(persons: DataFrame, column: str) -> DataFrame:
    """Weighted count per code, largest first."""
    return sort_rows(weighted_count(persons, [column], "PWGTP"), [("weighted_count", "desc"), column])


def population_tables(persons: DataFrame) -> dict[str, DataFrame]:
    tables = {"state": counts_by_state(persons)}
    for name, column in (("race", "RAC1P"), ("nativity", "NATIVITY")):
        if column in persons.columns:
            tables[name] = counts_by(persons, column)
    return tables


def top_occupations(
    persons: DataFrame,
    code,
    labels: DataFrame | None = None,
    titles: dict[str, str] = OCCUPATION_TITLES,
    n: int = 15,
    slots: list[str] = SLOTS,
) -> DataFrame:
    """Largest occupations of the employed aged 16 to 99; a person counts once per matching slot.

    ``labels`` holds (code, label). Shares are of all occupations, not of those listed.
    """
    counts = tabulate_slots(persons, "SOCP", {"AGEP": "16:99", "ESR": "1,2"}, "PWGTP", slots, code)
    counts = share_of_total(counts, "weighted_count")
    if labels is not None:
        counts = lookup_join(counts, labels.select("code", "label"), ["code"])
    else:
        counts = counts.withColumn("label", F.lit(None).cast("string"))
    named = counts.withColumn("label", fallback_label("code", "label", titles))
    return top_n(named, [("weighted_count", "desc"), "code"], n)


def insurance_coverage(
    persons: DataFrame,
    code,
    ages: str = "0:99",
    labels: DataFrame | None = None,
    slots: list[str] = SLOTS,
    fallback: dict[str, str] = COVERAGE_LABELS,
) -> DataFrame:
    """Coverage yes or no with rates; the fixed labels come before the published ones."""
    trimmed = persons.withColumn("HICOV", F.trim(F.col("HICOV").cast("string")))
    counts = tabulate_slots(trimmed, "HICOV", {"AGEP": ages}, "PWGTP", slots, code)
    counts = share_of_total(counts, "weighted_count", "rate")
    if labels is not None:
        counts = lookup_join(counts, labels.select("code", "label"), ["code"])
    else:
        counts = counts.withColumn("label", F.lit(None).cast("string"))
    named = counts.withColumn("label", override_label("code", "label", fallback))
    return sort_rows(named, [("weighted_count", "desc"), "code"])


def insurance_mix(
    persons: DataFrame,
    code,
    ages: str = "0:99",
    variables: list[str] | None = None,
    slots: list[str] = SLOTS,
    names: dict[str, str] = INSURANCE_LABELS,
) -> DataFrame:
    """Share of persons with each kind of insurance, of all persons with a known coverage; kinds overlap. One scan."""
    variables = variables or [v for v in names if v in persons.columns]
    rows = persons.where(parse_filters({"AGEP": ages}))
    known = F.col("HICOV").isNotNull()
    mix = indicator_mix(rows, variables, "PWGTP", slots=slots, code=code, universe=known)
    shares = mix.select(
        "variable",
        "weighted_count",
        safe_div("weighted_count", "universe").alias("percent"),
        F.coalesce(lookup("variable", names), "variable").alias("label"),
    )
    return sort_rows(shares, [("percent", "desc"), "variable"])


def largest_states(table: DataFrame, value: str, k: int, state: str = "state") -> DataFrame:
    """States with the largest value, as a one-column DataFrame."""
    typed = table.select(F.col(state), F.coalesce(num(F.col(value).cast("string")), F.lit(0.0)).alias("_v"))
    return top_n(typed, [("_v", "desc"), state], k).select(state)


def area_dashboard(
    persons: DataFrame,
    code,
    states: DataFrame | None = None,
    names: DataFrame | None = None,
    state: str = "STATE",
    area: str = "PUMA",
    slots: list[str] = SLOTS,
    as_string: bool = False,
) -> DataFrame:
    """Profile of the sub-population per state and area; ``states`` limits it, ``names`` (PUMA_CODE, puma_name) labels it.

    Codes are compared by value, or with ``as_string`` by text. An area without a name keeps its row.
    """
    rows = persons.where(any_slot(slots, code, as_string))
    if states is not None:
        rows = keep_members(rows, state, states, states.columns[0])
    rows = rename_alternates(rows, {area: ["public use microdata area"]})
    wide = group_profile(rows, [state, area])
    if names is not None:
        wide = lookup_join(wide.withColumn("PUMA_CODE", zero_pad(area, 5)), names, ["PUMA_CODE"])
    return wide
