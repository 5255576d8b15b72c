"""Profiles, fills and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.operators.ordered import exact_medians


def partition_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(*keys)


def distinct_counts(df: DataFrame, cols: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in cols])


def target_range(df: DataFrame, target: str) -> DataFrame:
    return df.agg(
        F.min(target).alias("lowest"),
        F.max(target).alias("highest"),
        F.avg(target).alias("mean"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """NULLs of every column in one pass."""
    names = df.columns if cols is None else cols
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])


def fill_constant(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fills NULLs of each numeric column with its exact median.

    ``df`` is read for the medians and for the fill: pass a written table.
    """
    medians = exact_medians(df, cols).select(F.struct(*cols).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), medians[c]) for c in cols})


def preview(df: DataFrame, cols: list[str], rows: int = 5) -> DataFrame:
    return df.select(*cols).limit(rows)
