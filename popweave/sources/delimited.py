"""Delimited files, read as text columns and typed later."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popweave.operators.schema import normalize_columns


def _reader(spark: SparkSession, glob: str | None, encoding: str, multiline: bool):
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("encoding", encoding)
        .option("multiLine", multiline)
    )
    return reader.option("pathGlobFilter", glob) if glob else reader


def scan_csv(
    spark: SparkSession, path: str | list[str], glob: str | None = None, encoding: str = "UTF-8", multiline: bool = False
) -> DataFrame:
    """Every column as text, so no leading zero is lost. ``glob`` picks parts by file name.

    Files are split across tasks unless ``multiline`` (line breaks inside quotes) is asked for.
    """
    return _reader(spark, glob, encoding, multiline).csv(path)


def year_from_name(name: Column) -> Column:
    """First four-digit year of a file name, NULL when there is none."""
    return F.nullif(F.regexp_extract(name, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def file_headers(spark: SparkSession, path: str | list[str], glob: str | None = "*.csv") -> DataFrame:
    """One row per file: path, header line, and whether all of it is valid UTF-8.

    One splittable scan; lines are reduced to one row per file and task before the shuffle. The header is the first line
    that is not blank, by row id, in the split that starts the file.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        (F.col("_metadata.file_block_start") == 0).alias("starts"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    return lines.groupBy("path").agg(
        F.min_by("value", F.when(F.col("starts") & (F.trim("value") != ""), F.col("row_id"))).alias("header"),
        F.bool_and(F.is_valid_utf8(F.col("value"))).alias("utf8"),
    )


def scan_drifting_csv(
    spark: SparkSession,
    path: str | list[str],
    glob: str | None = "*.csv",
    required: list[list[str]] | None = None,
    multiline: bool = False,
    with_year: bool = True,
    spellings: dict[str, list[str]] | None = None,
) -> DataFrame | None:
    """Union by column name of files whose headers, column order and encoding differ.

    Files that share a header and an encoding are read as one scan, so the plan grows with the number of layouts, not
    of files. Names are lower-cased and trimmed. ``required`` lists alternatives, any one of which a file must
    have; other files are skipped. ``spellings`` lists other names of a column; of those that a file has, the first counts,
    for the whole file. Returns None when no file qualifies.
    """
    # only file names and header lines come to the driver, which lists the files anyway
    layouts: dict[tuple[str, bool], list[str]] = {}
    for row in file_headers(spark, path, glob).collect():
        if row["header"]:
            layouts.setdefault((bytes(row["header"], "utf-8", "replace").decode(), row["utf8"]), []).append(
                unquote(row["path"])
            )
    parts = []
    for (_, utf8), files in sorted(layouts.items()):
        raw = scan_csv(spark, sorted(files), encoding="UTF-8" if utf8 else "ISO-8859-1", multiline=multiline)
        extra = [F.col("_metadata.file_name").alias("source_file")]
        if with_year:
            extra.append(year_from_name(F.col("_metadata.file_name")).alias("year"))
        named = [F.col(f"`{c}`") for c in raw.columns]
        part = normalize_columns(raw.select(*named, *extra))
        if required and not all(any(c in part.columns for c in options) for options in required):
            continue
        for target, names in (spellings or {}).items():
            if given := [n for n in names if n in part.columns]:
                part = part.withColumn(target, F.col(given[0]))
        parts.append(part)
    if not parts:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
