"""Mean targets of category values, out of fold, as a joined table.

A category value is replaced by the mean of the label over the rows that share it, drawn towards
the mean of all rows while it is rare. A training row must not see its own label, so rows are dealt
to folds and each gets the mean over the other folds; new rows get that over all. All of it is
one aggregate per (column, value, fold) and differences of its sums, for ten values or a billion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING = 10.0  # rows that the mean of all rows counts as
EVERY = -1  # the fold number under which the means over all folds stand


def with_random_fold(df: DataFrame, folds: int, seed: int, out: str = "fold") -> DataFrame:
    """Deals rows to folds. Write the result: the numbers hold for one reading of ``df``.

    A fold by content would keep copies of a row together; a value whose rows are all copies would
    then never see its own mean.
    """
    return df.withColumn(out, F.floor(F.rand(seed) * folds).cast("int"))


def fold_sums(rows: DataFrame, cols: list[str], label: str, fold: str = "fold") -> DataFrame:
    """Rows and label sum per (column, value, fold); column and value '' stand for all rows."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]
    whole = F.struct(F.lit("").alias("column"), F.lit("").alias("value"))
    long = rows.select(
        F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"),
        F.explode(F.array(*cells, whole)).alias("c"),
    )
    return long.groupBy("c.column", "c.value", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("total")
    )


def target_means(sums: DataFrame, folds: list[int], smoothing: float = SMOOTHING) -> DataFrame:
    """Per (column, value, fold): rows outside the fold and their smoothed mean label. Pass a
    written table."""
    whole = sums.groupBy("column", "value").agg(
        F.sum("n").alias("all_n"), F.sum("total").alias("all_total")
    )
    every = F.explode(F.array(*[F.lit(f) for f in [EVERY, *folds]])).alias("fold")
    own = whole.select("*", every).join(sums, ["column", "value", "fold"], "left")
    outside = own.select(
        "column", "value", "fold",
        (F.col("all_n") - F.coalesce("n", F.lit(0))).alias("n"),
        (F.col("all_total") - F.coalesce("total", F.lit(0.0))).alias("total"),
    )
    # One row per fold. Where all rows lie in one fold, its mean is that of all rows.
    share = F.try_divide("total", "n")
    means = outside.filter("column = ''")
    general = means.filter(F.col("fold") == EVERY).select(share).scalar()
    prior = F.broadcast(means.select("fold", F.coalesce(share, general, F.lit(0.0)).alias("__prior")))
    smooth = (F.col("total") + smoothing * F.col("__prior")) / (F.col("n") + smoothing)
    mean = F.when(F.col("column") == "", F.col("__prior")).otherwise(smooth)
    return outside.join(prior, "fold").select("column", "value", "fold", "n", mean.alias("mean"))


def with_means(
    df: DataFrame, means: DataFrame, cols: list[str], fold: str | None = None, unseen: str = "prior"
) -> DataFrame:
    """Adds ``<column>__mean``: that of the row's ``fold``, or over all rows without one.

    A value without an entry gets the mean of all rows, or with ``unseen="drop"`` the row goes. The
    entries of a column are joined on the value; the planner broadcasts them when they measure small
    and otherwise splits a hot value's rows.
    """
    used = means if fold else means.filter(F.col("fold") == EVERY).drop("fold")
    on = ["fold"] if fold else []
    prior = used.filter("column = ''").select(*on, F.col("mean").alias("__prior"))
    out = df.withColumn("fold", F.col(fold)) if fold and fold != "fold" else df
    if fold:
        out = out.join(F.broadcast(prior), "fold", "left")  # one row per fold
    else:
        out = out.withColumn("__prior", prior.select("__prior").scalar())
    for c in cols:
        entry = used.filter(F.col("column") == c).select(
            *on, F.col("value").alias(c), F.col("mean").alias(f"{c}__mean")
        )
        out = out.join(entry, [*on, c], "left")
        if unseen == "drop":
            out = out.filter(F.col(f"{c}__mean").isNotNull())
        out = out.withColumn(f"{c}__mean", F.coalesce(f"{c}__mean", "__prior"))
    return out.drop("__prior")
