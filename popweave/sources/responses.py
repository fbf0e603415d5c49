"""JSON responses whose first row is the header, and code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROWS_TYPE = "array<array<string>>"


def header_rows(df: DataFrame, text: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of every document of header-first JSON, projected by name.

    Each document is matched against its own header, so pages may order their columns differently; a name a page does
    not have is NULL. Pages holding a header only, or nothing, yield no rows.
    """
    keep = keep or []
    parsed = df.select(*keep, F.from_json(F.col(text), ROWS_TYPE).alias("_rows"))
    located = parsed.select(
        *keep,
        F.explode(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))).alias("_row"),
        *[_position("_rows", c).alias(f"_at_{i}") for i, c in enumerate(columns)],
    )
    return located.select(*keep, *[F.get("_row", F.col(f"_at_{i}")).alias(c) for i, c in enumerate(columns)])


def _position(rows: str, name: str) -> Column:
    """Zero-based place of a name in the document's header, NULL when absent."""
    header = F.get(F.col(rows), F.lit(0))
    return F.nullif(F.array_position(header, name), F.lit(0)).cast("int") - 1


def scan_header_json(
    spark: SparkSession,
    path: str | list[str],
    columns: list[str] | None = None,
    glob: str | None = None,
    per_line: bool = False,
) -> DataFrame:
    """A directory of landed response pages, one to a file or one to a line, as one table.

    Without ``columns``, those of all pages' headers are used, in the order in which the pages, by path and line, name them.
    """
    reader = spark.read.option("wholetext", not per_line)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    docs = reader.text(path)
    if columns is None:
        header = F.get(F.from_json("value", ROWS_TYPE), F.lit(0))
        lines = docs.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), header.alias("header"))
        # Each file's different headers first, with a number as all they carry, so that a task holds those and no rows.
        headers = lines.where("header is not null").groupBy("path", "header").agg(F.min("line").alias("line"))
        page = F.struct("path", "line")
        names = headers.select(page.alias("page"), F.posexplode("header").alias("place", "name")).where("name is not null")
        first = names.groupBy("name").agg(F.min(F.struct("page", "place")).alias("first"))
        columns = [r["name"] for r in first.orderBy("first").collect()]  # as many as the table has columns
        if not columns:
            raise ValueError(f"no page with a header under {path}")
    return header_rows(docs, "value", columns)


def code_list(df: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """(code, label) rows of ``{"values": {code: label | {"label": label}}}`` documents."""
    keep = keep or []
    entries = df.select(
        *keep,
        F.explode(F.from_json(F.get_json_object(F.col(text), "$.values"), "map<string,string>")).alias("code", "_v"),
    )
    label = F.coalesce(F.when(F.col("_v").startswith("{"), F.get_json_object("_v", "$.label")), F.col("_v"))
    return entries.select(*keep, "code", label.alias("label"))


def scan_code_list(spark: SparkSession, path: str) -> DataFrame:
    return code_list(spark.read.option("wholetext", True).text(path), "value")
