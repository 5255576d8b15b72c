"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Shuffle files of an SQL execution are removed when it ends, not when the driver collects garbage.
RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(
    cpus: str | int = "*", shuffle_partitions: int = 8, hive: bool = False
) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own.

    ``hive`` keeps the catalog in a Hive metastore instead of memory.
    """
    builder = SparkSession.builder.enableHiveSupport() if hive else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName("cutline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession, label: str = "run") -> str:
    """A fresh path below the shared folder the session names.

    The folder is ``spark.checkpoint.dir``. Only a local session may fall back to
    the machine's own temporary folder: on a cluster other hosts could not read it.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cutline-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts lineage in a way that survives lost executors, and fixes the rows where a
    frame feeds several jobs (a model fit followed by scoring). The shuffles of the write are
    released as it ends: later jobs read the files.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    with setting(spark, RELEASE_SHUFFLES, "true"):
        df.write.mode("overwrite").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def discard(made: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` gave and nothing reads any more."""
    context = made.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(made.scratch_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
