"""Summary-table estimates by state, county and tract."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popweave.functions.codes import STATE_NAMES, STATE_POSTAL, label, lookup
from popweave.functions.numbers import count_int, marker_size, num, number, strict_sum, visibility
from popweave.functions.predicates import comparable, within_cap
from popweave.functions.text import prefixed_label, strip_suffix_text, zero_pad
from popweave.operators.joins import lookup_join
from popweave.operators.ranking import Order, sort_rows, top_n, top_n_resorted


def state_estimates(
    raw: DataFrame, parts: list[str], total_name: str = "total", names: dict[str, str] = STATE_NAMES
) -> DataFrame:
    """Numeric parts of a summary table, their total (missing if a part is), and the state's name or else its code."""
    typed = raw.withColumns({p: num(p) for p in parts})
    return typed.select(
        "NAME",
        *parts,
        F.col("state").alias("state_fips"),
        *([strict_sum(*parts).alias(total_name)] if len(parts) > 1 else []),
        label("state", names, width=2).alias("state_name"),
    )


def county_estimates(raw: DataFrame, parts: list[str], state: str, total_name: str = "total") -> DataFrame:
    """The same for the counties of one state."""
    typed = raw.where(F.col("state") == state.zfill(2)).withColumns({p: num(p) for p in parts})
    return typed.select(
        "NAME",
        *parts,
        F.col("state").alias("state_fips"),
        F.col("county").alias("county_fips"),
        strict_sum(*parts).alias(total_name),
    )


def birthplace_by_state(raw: DataFrame, part: str, names: dict[str, str] = STATE_NAMES) -> DataFrame:
    return state_estimates(raw, [part], names=names)


def counts_by_state(raw: DataFrame, part: str, out: str = "count") -> DataFrame:
    """Whole counts, unreadable ones as 0, largest first."""
    counts = raw.select("NAME", "state", count_int(part).alias(out))
    return sort_rows(counts, [(out, "desc"), "state"])


def top_states(counts: DataFrame, n: int = 12, value: str = "weighted_count") -> DataFrame:
    """Largest states with their postal abbreviation; column names ignore case, so it is not called ``state``."""
    named = counts.withColumn("postal", label("STATE", STATE_POSTAL, width=2))
    return top_n(named, [(value, "desc"), "STATE"], n)


def visibility_table(ancestry: DataFrame, birthplace: DataFrame, counts: DataFrame) -> DataFrame:
    """Per state: ancestry and birthplace totals, weighted count, marker size and their ratio.

    ``ancestry`` (state_fips, ancestry), ``birthplace`` (state_fips, born), ``counts`` (STATE, weighted_count).
    """
    keyed = ancestry.withColumn("state_fips", zero_pad("state_fips", 2))
    born = birthplace.select(zero_pad("state_fips", 2).alias("state_fips"), number(birthplace, "born").alias("born"))
    weighted = counts.select(zero_pad("STATE", 2).alias("state_fips"), "weighted_count")
    combo = lookup_join(lookup_join(keyed, born, ["state_fips"]), weighted, ["state_fips"])
    return combo.select(
        "state_fips",
        F.coalesce(lookup("state_fips", STATE_POSTAL), "state_fips").alias("state"),
        number(combo, "ancestry").alias("ancestry"),
        "born",
        "weighted_count",
        marker_size("weighted_count", combo.select(F.max("weighted_count")).scalar()).alias("size"),
        visibility(number(combo, "ancestry"), "born").alias("ratio"),
    )


def visibility_ratios(table: DataFrame, annotate: int | None = None) -> DataFrame:
    """Rows where the ratio is defined, largest ancestry first; only the first few, if asked, as chart annotations."""
    rows = table.where(comparable("ancestry", "born"))
    order: Order = [("ancestry", "desc"), "state_fips"]
    return top_n(rows, order, annotate) if annotate else sort_rows(rows, order)


def dense_cluster(table: DataFrame, cap: float = 50000) -> DataFrame:
    return table.where(within_cap("born", "ancestry", cap))


def labelled_counts(
    counts: DataFrame, code: str, labels: dict[str, str], prefix: str | None = None, n: int | None = None
) -> DataFrame:
    """Counts with a label, or the (prefixed) code where there is none; the largest ones if a number is given."""
    text = F.col(code).cast("string")
    unknown = prefixed_label(prefix, code) if prefix else text
    named = counts.withColumn("label", F.coalesce(lookup(text, labels), unknown))
    order: Order = [("weighted_count", "desc"), code]
    return top_n(named, order, n) if n else sort_rows(named, order)


def top_counties(counties: DataFrame, suffix: str, n: int = 15, value: str = "total") -> DataFrame:
    """Largest counties, smallest of them first as a bar chart draws them, the common suffix of their names removed."""
    named = counties.withColumn("label", strip_suffix_text("NAME", suffix))
    return top_n_resorted(named, [(value, "desc"), "NAME"], n, [value, "NAME"])


def county_map(shapes: DataFrame, counties: DataFrame, state: str) -> DataFrame:
    """One state's county shapes with their estimates, shapes without an estimate included.

    ``shapes`` (STATEFP, COUNTYFP, ...), ``counties`` (county_fips, ...).
    """
    of_state = shapes.where(F.col("STATEFP") == state)
    keyed = counties.withColumn("county_fips", zero_pad("county_fips", 3))
    return lookup_join(of_state, keyed, {"COUNTYFP": "county_fips"})
