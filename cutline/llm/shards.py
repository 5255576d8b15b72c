"""Weighted rendezvous hashing of record keys over shards.

Each (key, shard) pair has a uniform number ``u`` from a 64-bit hash; the shard with the least
``-ln(u) / weight`` owns the key. Shares follow the weights, and a further shard only takes
the keys for which its own number is least: nothing moves between the old ones.

Edge cases: a NULL key is a key like any other; repeated rows share a shard and get slots of
their own; NULL text has size 1 and checksum 0; an empty table stays empty; input columns
named like output columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import materialise

SLOT_ROWS = 20_000  # rows of all shards that share a slot range


def scores(key: Column | str, weights: list[float], seed: int = 7) -> list[Column]:
    """One number per shard; the least one wins."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    out = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard), F.lit(seed)), 11)
        out.append(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight)))
    return out


def assign(
    df: DataFrame,
    key: str,
    weights: list[float],
    shard: str = "shard",
    grown: str | None = None,
    grown_weight: float = 1.0,
) -> DataFrame:
    """``df`` with its shard, and with ``grown`` the shard after one more has been added."""
    every = scores(key, [*weights, grown_weight])
    old = F.array(*[F.struct(s.alias("s"), F.lit(k).alias("k")) for k, s in enumerate(every[:-1])])
    best = df.withColumn("__best", F.array_min(old)).withColumn(shard, F.col("__best.k"))
    if grown:
        taken = every[-1] < F.col("__best.s")
        best = best.withColumn(grown, F.when(taken, len(weights)).otherwise(F.col("__best.k")))
    return best.drop("__best")


def with_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``df`` with a gapless position in its shard, from 0.

    Rows are dealt over ranges by a hash of ``order``; a range is numbered by itself and starts
    where the counts of the ranges before it end. No task sees a whole shard. ``df`` is read
    twice: pass a written table.
    """
    ranges = max(1, math.ceil(df.count() / SLOT_ROWS))
    dealt = df.withColumn("__range", F.pmod(F.xxhash64(*order), F.lit(ranges)))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(shard, "__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(
        shard, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    within = Window.partitionBy(shard, "__range").orderBy(*order)
    return (
        dealt.withColumn("__at", F.row_number().over(within) - 1)
        .join(starts, [shard, "__range"])
        .withColumn(slot, (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__range", "__start", "__at")
    )


def op5_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards by key."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = materialise(assign(docs, "doc_id", [1.0] * 16, grown="grown_shard"), "shards")
    slots = with_slots(placed, "shard", ["doc_id", "size", "text_crc32"])
    return slots.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
