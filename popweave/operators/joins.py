"""Joins to lookups, bridges and year-aware directories.

No broadcast is forced: Spark broadcasts a side whose measured size is under its own threshold, and splits skewed partitions
of the other joins at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from popweave.operators.ranking import latest_per_key


def lookup_join(left: DataFrame, right: DataFrame, on: list[str] | dict[str, str], how: str = "left") -> DataFrame:
    """Equi-join; ``{left name: right name}`` keeps both keys, a list of shared names keeps one."""
    if isinstance(on, dict):
        cond = F.lit(True)
        for a, b in on.items():
            cond = cond & (left[a] == right[b])
        return left.join(right, cond, how)
    return left.join(right, on, how)


def keep_members(df: DataFrame, key: str, members: DataFrame, member_key: str | None = None) -> DataFrame:
    """Rows whose key is in a set that is itself a DataFrame."""
    keys = members.select(F.col(member_key or key).alias(key))
    return df.join(keys, key, "left_semi").select(*df.columns)


# bits of the map of ``likely_members``: one megabyte, whatever there is on either side
MEMBER_BITS = 1 << 23


def likely_member(key: str, members: DataFrame, member_key: str | None = None, bits: int = MEMBER_BITS) -> Column:
    """Whether a key is in the set; also true of about one in ``bits / members`` of the others, and of no missing key.

    The set becomes a bit map of fixed size by hash, one scalar of the plan, so rows are told apart where they are read.
    """
    def place(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(name).cast("string")), F.lit(bits)) + 1

    marked = members.where(F.col(member_key or key).isNotNull()).select(place(member_key or key).alias("_h"))
    parts = marked.groupBy(F.bitmap_bucket_number("_h").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("map")
    )
    whole = parts.select(F.map_from_entries(F.collect_list(F.struct("part", "map"))).alias("maps")).scalar()
    at = F.bitmap_bit_position(place(key))
    byte = F.substring(F.try_element_at(whole, F.bitmap_bucket_number(place(key))), (at / 8).cast("int") + 1, F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), (at % 8).cast("int")) == 1
    return F.col(key).isNotNull() & F.coalesce(is_set, F.lit(False))


def likely_members(df: DataFrame, key: str, members: DataFrame, member_key: str | None = None, bits: int = MEMBER_BITS) -> DataFrame:
    """Rows whose key is in the set, and the few others of ``likely_member``; to thin out wide rows before a join."""
    return df.where(likely_member(key, members, member_key, bits))


def without_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose key is not in the set, which is read twice; a missing key is in no set.

    Rows that are surely not in it go where they are read, so the join moves the others alone.
    """
    likely = likely_member(key, members)
    return df.where(~likely).unionByName(df.where(likely).join(members.select(key), key, "left_anti").select(*df.columns))


def join_preferring_right(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on shared keys; a column of both sides is the right one's value, the left one's where that is missing."""
    both = [c for c in left.columns if c in right.columns and c not in on]
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in both})
    joined = left.join(renamed, on, how)
    merged = {c: F.coalesce(F.col(f"_right_{c}"), F.col(c)) for c in both}
    return joined.withColumns(merged).drop(*[f"_right_{c}" for c in both]) if both else joined


def join_directory(
    facts: DataFrame,
    directory: DataFrame,
    key: str,
    year: str,
    fields: list[str],
    fallback: str = "row",
) -> DataFrame:
    """Attach directory fields of the same key and year, else those of the key's latest entry.

    The first field tells whether an entry was found. With ``fallback="all"`` a single row without an entry sends every row
    to the latest entries. An unknown year equals an unknown year.
    """
    if fallback not in ("row", "all"):
        raise ValueError("fallback is row or all")
    entries = directory.select(
        F.col(key).alias("_key"), F.col(year).alias("_year"), *[F.col(f).alias(f"_same_{f}") for f in fields]
    )
    latest = latest_per_key(directory.select(key, year, *fields), [key], year, fields).select(
        F.col(key).alias("_latest_key"), *[F.col(f).alias(f"_latest_{f}") for f in fields]
    )
    same_year = facts.join(
        entries, (F.col(key) == F.col("_key")) & F.col(year).eqNullSafe(F.col("_year")), "left"
    ).drop("_key", "_year")
    missing: Column = F.col(f"_same_{fields[0]}").isNull()
    if fallback == "all":
        missing = F.coalesce(same_year.select(F.bool_or(missing)).scalar(), F.lit(False))
    joined = same_year.join(latest, F.col(key) == F.col("_latest_key"), "left")
    return joined.select(
        *facts.columns, *[F.when(missing, F.col(f"_latest_{f}")).otherwise(F.col(f"_same_{f}")).alias(f) for f in fields]
    )
