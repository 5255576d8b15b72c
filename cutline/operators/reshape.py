"""Unpivot, union, dedup and row multiplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_courses(
    df: DataFrame,
    ids: list[str] | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """Wide rows to ``course_name``/``rank`` rows.

    The id columns are the first three unless named; ``names`` renames them. All other
    columns are courses. Fewer than one course column gives no rows, and so does a file that is
    too narrow for three id columns.
    """
    if ids is None and len(df.columns) < 3:
        columns = [*(names or [f"id_{k}" for k in range(3)]), "course_name", "rank"]
        return df.select(*[F.lit("").alias(c) for c in columns]).filter(F.lit(False))
    id_cols = list(df.columns[:3]) if ids is None else ids
    courses = [c for c in df.columns if c not in id_cols]
    if not courses:
        empty = df.select(*id_cols, F.lit("").alias("course_name"), F.lit("").alias("rank"))
        long = empty.filter(F.lit(False))
    else:
        quoted = [f"`{c}`" for c in courses]
        long = df.unpivot([f"`{c}`" for c in id_cols], quoted, "course_name", "rank")
    if names is not None:
        long = long.toDF(*names, "course_name", "rank")
    return long


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_highest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key with the highest ``value``.

    An aggregate instead of ``dropDuplicates``: the result does not depend on row order
    and copies collapse before the shuffle.
    """
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def drop_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Any one row per key."""
    return df.dropDuplicates(keys)


def keep_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in wanted if c in df.columns])


def add_missing(df: DataFrame, wanted: list[str], value: float = 0) -> DataFrame:
    """Adds wanted columns that do not exist as a constant, then projects."""
    missing = {c: F.lit(value) for c in wanted if c not in df.columns}
    return df.withColumns(missing).select(*wanted) if missing else df.select(*wanted)
