"""Vocabularies of category values and lookups into them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.functions.text import vocab_text
from cutline.operators.ordered import with_position

UNKNOWN = "__UNKNOWN__"  # fixed value


def build_vocabulary(df: DataFrame, col: str, with_unknown: bool = False) -> DataFrame:
    """Distinct normalised values with an id from 0 in alphabetical order."""
    values = df.select(vocab_text(col).alias("value")).filter(F.col("value").isNotNull())
    if with_unknown:
        unknown = df.sparkSession.range(1).select(F.lit(UNKNOWN).alias("value"))
        values = values.unionByName(unknown)
    numbered = with_position(values.distinct(), [], ["value"])
    return numbered.select("value", (F.col("pos") - 1).alias("id"))


def lookup_or_unknown(df: DataFrame, col: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """Adds the id of the value; a value not in the vocabulary gets the unknown id.

    A vocabulary without the unknown entry gives 0, as the older lookup does. Pass a
    written vocabulary: it is read for the join and for the unknown id. Its measured
    size decides whether the join broadcasts it.
    """
    entry = vocabulary.withColumnsRenamed({"value": "__value", "id": "__id"})
    unknown = vocabulary.filter(F.col("value") == UNKNOWN).agg(F.max("id")).scalar()
    hit = df.join(entry, vocab_text(col) == F.col("__value"), "left")
    filled = F.coalesce(F.col("__id"), unknown, F.lit(0).cast("long"))
    return hit.withColumn(out, filled).drop("__value", "__id")


def keep_known(df: DataFrame, col: str, vocabulary: DataFrame) -> DataFrame:
    """Drops the rows whose value is not in the vocabulary."""
    entry = vocabulary.select(F.col("value").alias("__value"))
    return df.join(entry, vocab_text(col) == F.col("__value"), "left_semi")
