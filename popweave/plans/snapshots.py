"""Monthly snapshot pages to country summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from popweave.functions.numbers import count_int
from popweave.functions.predicates import flagged, year_month_between
from popweave.functions.text import snapshot_slug
from popweave.operators.joins import likely_members
from popweave.operators.ranking import Order, sort_rows
from popweave.session import even_parts
from popweave.plans.education import COUNT_PATTERNS, COUNTRY_PATTERNS, SCHOOL_PATTERNS, STATE_PATTERNS
from popweave.sources.pages import column_index, drop_repeated_headers, extract_html_tables, main_table

# Fixed value: words that tell a header row.
HEADER_TOKENS = r"(StateAbbrv|CoC|Country|Student\s*Education\s*Level|Count\s+of\s+Active|Active\s+Students)"


def wanted_links(
    links: DataFrame, flag: bool | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Links of the wanted kind and months, undated ones included."""
    rows = links.where(year_month_between("year", "month", start, end))
    return rows if flag is None else rows.where(flagged("flag", flag))


def select_links(
    links: DataFrame, flag: bool | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """``wanted_links``, oldest first."""
    rows = wanted_links(links, flag, start, end)
    order = [F.coalesce("year", F.lit(0)), F.coalesce("month", F.lit(0)), F.col("flag"), F.col("url")]
    return rows.orderBy(*order)


def snapshot_tables(links: DataFrame, pages: DataFrame, tag: str = "flagged", page_suffix: str = "") -> DataFrame:
    """Each link's page with its main table: url, year, month, flag, slug, source, header, rows, csv_url.

    A page that landed more than once counts once, with its greatest text, as nothing tells which landing is newer. Pages
    without a link go where they are read, before anything is shuffled. Those left are dealt once, by url, into as many parts
    as there are links to parse, which the join keeps.
    """
    linked = likely_members(pages.select("url", "html"), "url", links).repartition(even_parts(links), "url")
    landed = links.join(linked.groupBy("url").agg(F.max("html").alias("html")), "url")
    tables = main_table(extract_html_tables(landed), tokens=HEADER_TOKENS).drop("html")
    slug = snapshot_slug(F.col("year"), F.col("month"), F.col("flag"), F.col("url"), tag, page_suffix)
    return tables.withColumn("slug", slug)


def _cell(row: Column, at: Column) -> Column:
    return F.get(row, at)


def _country_rows(tables: DataFrame, country: str) -> DataFrame:
    """Pages with a country and a count column: their places of columns, and only the country's rows, still nested."""
    placed = tables.withColumns(
        {
            "_country": column_index("header", COUNTRY_PATTERNS),
            "_state": column_index("header", STATE_PATTERNS),
            "_school": column_index("header", SCHOOL_PATTERNS),
            "_count": column_index("header", COUNT_PATTERNS),
        }
    ).where("_country is not null and _count is not null")
    wanted = F.lit(country.strip().lower())
    return placed.withColumn("rows", F.filter("rows", lambda r: F.lower(F.trim(F.get(r, F.col("_country")))) == wanted))


def state_by_month(tables: DataFrame, country: str) -> DataFrame:
    """(year, month, flag, state, total) per snapshot; a snapshot without states gives one total with state NULL."""
    rows = _country_rows(tables, country)
    count = lambda r: count_int(F.get(r, F.col("_count")))
    by_state = F.filter(
        F.transform("rows", lambda r: F.struct(F.get(r, F.col("_state")).alias("state"), count(r).alias("n"))),
        lambda s: s["state"].isNotNull(),
    )
    overall = F.array(
        F.struct(
            F.lit(None).cast("string").alias("state"),
            F.aggregate(F.transform("rows", count), F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n"),
        )
    )
    cells = rows.select(
        "url", "year", "month", "flag", F.inline(F.when(F.col("_state").isNotNull(), by_state).otherwise(overall))
    )
    sums = cells.groupBy("url", "year", "month", "flag", "state").agg(F.sum("n").alias("total")).drop("url")
    return sort_rows(sums, ["year", "month", "state", "flag"])


def school_by_month(tables: DataFrame, country: str) -> DataFrame:
    """(year, month, flag, institution, state, total) of the snapshots that name schools."""
    rows = _country_rows(tables, country).where("_school is not null")
    cells = rows.select(
        "url", "year", "month", "flag", F.col("_state").isNotNull().alias("_has_state"),
        F.inline(
            F.transform(
                "rows",
                lambda r: F.struct(
                    F.get(r, F.col("_school")).alias("institution"),
                    F.get(r, F.col("_state")).alias("state"),
                    count_int(F.get(r, F.col("_count"))).alias("n"),
                ),
            )
        ),
    ).where("institution is not null and (state is not null or not _has_state)")
    sums = cells.groupBy("url", "year", "month", "flag", "institution", "state").agg(F.sum("n").alias("total")).drop("url")
    order: Order = ["year", "month", "institution", "state", "flag"]
    return sort_rows(sums, order)


def named_rows(tables: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Table rows with the listed columns by name; a name a page does not have is NULL."""
    rows = tables.select(
        *keep,
        F.explode("rows").alias("_r"),
        *[(F.nullif(F.array_position("header", c), F.lit(0)).cast("int") - 1).alias(f"_at{i}") for i, c in enumerate(columns)],
    )
    return rows.select(*keep, *[F.get("_r", F.col(f"_at{i}")).alias(c) for i, c in enumerate(columns)])


def page_table(pages: DataFrame, keep: list[str] = ["url"]) -> DataFrame:
    """The widest table of each page, cleaned: empty rows and repeated headers dropped."""
    return drop_repeated_headers(main_table(extract_html_tables(pages))).select(*keep, "source", "header", "rows")
