"""Sinks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.session import setting

# Files that a task of a partitioned CSV write holds open; rows of further folders are sorted.
OPEN_FILES = 32

def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    files_per_partition: int = 1,
) -> None:
    """Overwrites ``path``.

    Partitioned output is rebalanced on the partition columns first: one directory
    gets few files. The hint lets AQE split a directory that holds most of the rows
    over several tasks, where a plain ``repartition`` would send it to one.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    if files_per_partition > 1:
        slot = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))
        df = df.repartition(*partition_by, slot)
    else:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_parquet(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Adds rows to a partitioned table; an empty frame adds no file."""
    df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def write_split(
    df: DataFrame,
    routes: dict[str, Column],
    partition_by: list[str] | None = None,
) -> None:
    """Routes one frame to several outputs, path by predicate.

    The frame is kept on disk and in memory while the writes run, so its plan is
    computed once; blocks of a lost executor are recomputed.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for path, predicate in routes.items():
            write_parquet(kept.filter(predicate), path, partition_by)
    finally:
        kept.unpersist()


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites ``path``, with a folder per value of ``partition_by``.

    A task keeps a file open per folder, up to ``OPEN_FILES``: rows go out as they come, where Spark
    would otherwise sort all rows of the task by folder first, in memory that grows with the input.
    """
    writer = df.write.mode("overwrite").option("header", True)
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES)):
        writer.partitionBy(*(partition_by or [])).csv(path)


def write_csv_text(df: DataFrame, path: str) -> None:
    """CSV that keeps white space, quotes and line breaks inside cells."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
