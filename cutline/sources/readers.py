"""Scans. Every path may be any Hadoop file system URI."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str,
    check_header: bool = False,
    recursive: bool = False,
) -> DataFrame:
    """CSV file or directory with a declared schema, bound by position.

    A cell that does not parse becomes NULL. ``check_header`` raises when the header
    names differ from the schema, instead of silently reading the wrong columns.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", not check_header)
        .option("recursiveFileLookup", recursive)
        .csv(path)
    )


def read_csv_text(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV whose quoted cells may span lines; every column is a string.

    Spark cannot split such a file, so one file is one task: keep files small.
    """
    reader = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def with_source_year(df: DataFrame, base_path: str) -> DataFrame:
    """Adds ``year``: the first run of four digits in the path below ``base_path``.

    Digits in ``base_path`` itself are not looked at. Rows of files without such a run
    are dropped.
    """
    return df.withColumn("year", year_of(below(base_path))).filter(F.col("year").isNotNull())


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table or partitioned directory, partition columns included.

    Category codes such as ``1`` or ``02`` are partition values; set
    ``spark.sql.sources.partitionColumnTypeInference.enabled=false`` to keep them text,
    or use :func:`read_partitioned`.
    """
    return spark.read.parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Partitioned Parquet directory with declared types, so text codes stay text."""
    return spark.read.schema(schema).parquet(path)


def read_years(
    spark: SparkSession,
    years: Iterable[int],
    load: Callable[[int], DataFrame],
    empty_schema: str,
) -> DataFrame:
    """Union by name of one frame per year; years without a file are left out.

    A year whose file has no valid row simply adds no rows, and no file at all gives
    an empty frame with the declared schema, so no counting action is needed.
    """
    frames = []
    for year in years:
        try:
            frames.append(load(year).withColumn("year", F.lit(year)))
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    if not frames:
        return spark.createDataFrame([], empty_schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def years_in(spark: SparkSession, folder: str, prefix: str, suffix: str = ".csv") -> list[int]:
    """Years of the files ``<prefix><year><suffix>`` in a folder of any file system, rising."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{prefix}*{suffix}")
    found = target.getFileSystem(conf).globStatus(target) or []
    names = [f.getPath().getName()[len(prefix) : -len(suffix)] for f in found]
    return sorted(int(n) for n in names if len(n) == 4 and n.isdigit())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority of its file system."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(conf).makeQualified(target).toString()


def below(base_path: str):
    """Path of a row's file below ``base_path``."""
    return F.substring_index(F.col("_metadata.file_path"), base_path.rstrip("/") + "/", -1)


def year_of(path) -> Column:
    """First run of four digits in a path, or NULL."""
    return F.nullif(F.regexp_extract(path, r"(\d{4})", 1), F.lit("")).try_cast("int")


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    """First path that exists on its file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    tried = list(paths)
    for path in tried:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            return path
    raise FileNotFoundError(", ".join(tried))
