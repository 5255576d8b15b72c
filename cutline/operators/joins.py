"""Statistics of a row's group, joins of few keys, and the product of numbered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS_PER_TASK = 1_000_000
TILE = 1024  # rows of each side that meet at once


def with_group_stats(df: DataFrame, keys: list[str], **aggs) -> DataFrame:
    """Adds aggregates of the row's group.

    Aggregate and join back instead of a window: the aggregate combines on the map side,
    and the adaptive join broadcasts it when it measured small or splits a hot group.
    ``df`` is read twice: pass a written table, not a long plan.
    """
    stats = df.groupBy(*keys).agg(*[col.alias(name) for name, col in aggs.items()])
    return df.join(stats, keys, "left")


def tiled_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner equi join of few keys that hold many rows on both sides, so that no key is one task's work.

    The rows of a key are dealt by their content into tiles of some ``TILE`` rows on either side, and
    each pair of tiles is a key of its own. Both sides are read twice: pass written tables whose rows
    differ.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(name))

    sizes = tiles(left, "__left").join(tiles(right, "__right"), on)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        names = {own: F.pmod(F.xxhash64(*df.columns), F.col(own)), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}
        rows = df.join(sizes, on).withColumn(own, names[own].cast("int")).withColumn(other, names[other])
        return rows.repartition(n, *on, "__left", "__right")

    met = dealt(left, "__left", "__right").join(dealt(right, "__right", "__left"), [*on, "__left", "__right"])
    return met.drop("__left", "__right")


def _stride(sizes: list[int]) -> int:
    out = 1
    for n in sizes:
        out *= max(n, 1)
    return out


def product(parts: list[DataFrame], index: str = "id") -> DataFrame:
    """Every combination of a row of each part; ``index`` numbers each part's rows from 0.

    The cells are the numbers of one range, split evenly whatever the parts' sizes; a cell's
    number says which row of each part it holds, and an equi join fetches it. No part is repeated,
    and the planner broadcasts those that measure small. Numbers without a row make no cells.
    """
    spark = parts[0].sparkSession
    last = [p.agg(F.max(index)).first()[0] for p in parts]
    sizes = [0 if n is None else n + 1 for n in last]
    total = 0 if 0 in sizes else _stride(sizes)
    tasks = max(1, spark.sparkContext.defaultParallelism, total // CELLS_PER_TASK)
    cells, rest = spark.range(0, total, 1, tasks).withColumnRenamed("id", "__cell"), F.col("__cell")
    for k, n in enumerate(sizes):
        cells = cells.withColumn(f"__at{k}", F.pmod(rest, F.lit(max(n, 1))))
        rest = F.expr(f"__cell div {_stride(sizes[: k + 1])}")
    for k, part in enumerate(parts):
        cells = cells.join(part.withColumnRenamed(index, f"__at{k}"), f"__at{k}")
    return cells.drop("__cell", *[f"__at{k}" for k in range(len(parts))])
