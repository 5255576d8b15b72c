"""External tables over Parquet directories."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_tables(spark: SparkSession, database: str, tables: dict[str, str]) -> None:
    """Creates the database and one external table per name/path pair.

    A partitioned directory reads as empty until its partitions are recovered, so
    that is done here. A name registered before gets the new path (files stay). The
    metastore (in memory or Hive) is the session's choice.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, path in tables.items():
        table = f"{database}.{name}"
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.read.parquet(path)  # a path that cannot be read leaves the old registration
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} USING parquet OPTIONS (path '{place}')")
        if any(column.isPartition for column in spark.catalog.listColumns(table)):
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
