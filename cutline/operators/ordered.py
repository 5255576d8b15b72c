"""Exact ranks and order statistics over groups of any size.

A plain ``percent_rank``/``row_number``/``median`` sends a whole group to one task, and
the groups here are coarse: a cohort, a category, a label, or the whole table. These
operators never do that. Rows are dealt to ranges of (keys, order) that Spark samples, so
ranges hold like numbers of rows however narrow the values lie or however long their common
beginning is. Each range is summed by itself; a prefix sum over the ranges, one row per
range and group, gives each its start.

Ranges cannot split equal rows. :func:`running_counts` therefore works on one count
per distinct value, and :func:`with_percent_rank` joins the counts back; values that hold a large
share of all rows are sent to the rows instead of the rows to them. There is one path for
every size. NULL sorts first and NaN last, as in Spark's own windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import materialise

# A value that holds more than one in so many rows is hot; there are fewer than that.
HOT_SHARE = 1000


def match_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"):
    """Equi join on ``keys`` where NULL matches NULL; the right copies are dropped."""
    tag = {k: f"__r_{k}" for k in keys}
    renamed = right.withColumnsRenamed(tag)
    cond = F.lit(True)
    for k, r in tag.items():
        cond = cond & F.col(k).eqNullSafe(F.col(r))
    return left.join(renamed, cond, how).drop(*tag.values())


def attach(df: DataFrame, facts: DataFrame, on: list[str], size: str = "n") -> DataFrame:
    """``df`` with the facts of its group, NULL where there are none; NULL keys match.

    ``facts`` has a row per group and the number of the group's rows of ``df`` in ``size``. Groups
    with more than 1 in ``HOT_SHARE`` rows, fewer than that many, are broadcast, so a hot group is
    not gathered in one task; the others meet their rows by shuffle or as measured. Both
    sides are read more than once: pass written tables.
    """
    told = facts.agg(F.count(F.lit(1)).alias("k"), F.sum(size).alias("n"), F.max(size).alias("m"))
    groups, rows, largest = told.first()
    most = (rows or 0) / HOT_SHARE
    if groups <= HOT_SHARE or largest <= most:
        return match_null_safe(df, facts, on, "left")
    hot = F.broadcast(facts.filter(F.col(size) > most).withColumn("__hot", F.lit(True)))
    marked = match_null_safe(df, hot, on, "left")
    made = [c for c in marked.columns if c not in df.columns]
    cold = marked.filter(F.col("__hot").isNull()).drop(*made)
    cold = match_null_safe(cold, facts.filter(F.col(size) <= most), on, "left")
    return marked.filter("__hot").drop("__hot").unionByName(cold)


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in sampled ranges of ``order``, numbered by ``__part``.

    Every row of a range sorts before every row of the next one. The table is written, so
    a lost executor cannot move a row to another range.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    return materialise(ranged.withColumn("__part", F.spark_partition_id()), "ranges")


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: list[str]
) -> DataFrame:
    """Adds ``<s>_upto`` (sum of column ``s`` up to and with the row) and ``<s>_total`` per group.

    Rows should differ in (keys, order); equal ones lie in one range, in any order.
    """
    ranged = in_ranges(df, [*keys, *order])
    place = [*keys, "__part"]
    upto = Window.unboundedPreceding, Window.currentRow
    within = Window.partitionBy(*place).orderBy(*order).rowsBetween(*upto)
    inner = ranged.withColumns({f"__{s}_in": F.sum(s).over(within) for s in sums})

    per_range = ranged.groupBy(*place).agg(*[F.sum(s).alias(f"__{s}_sum") for s in sums])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        *place,
        *[F.coalesce(F.sum(f"__{s}_sum").over(before), F.lit(0)).alias(f"__{s}_off") for s in sums],
        *[F.sum(f"__{s}_sum").over(group).alias(f"{s}_total") for s in sums],
    )
    return match_null_safe(inner, starts, place).select(
        *df.columns,
        *[(F.col(f"__{s}_in") + F.col(f"__{s}_off")).alias(f"{s}_upto") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def running_counts(
    df: DataFrame,
    keys: list[str],
    value: str,
    weights: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (keys, value) with ``n``, ``n_below`` and ``n_total``.

    ``n_below`` counts the rows of the group with a smaller value. ``weights`` replaces
    the row count ``n`` by named sums, each with its ``_below`` and ``_total``.
    """
    sums = weights or {"n": F.lit(1)}
    per_value = df.groupBy(*keys, value).agg(
        *[F.sum(w).cast("long").alias(name) for name, w in sums.items()]
    )
    summed = running_sums(per_value, keys, [value], list(sums))
    return summed.select(
        *keys,
        value,
        *sums,
        *[(F.col(f"{n}_upto") - F.col(n)).alias(f"{n}_below") for n in sums],
        *[f"{n}_total" for n in sums],
    )


def with_percent_rank(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds ``percent_rank()`` of ``value`` within ``keys`` (0 for a group of one).

    As in Spark's own window, NULL counts as the least value and NaN as the greatest. ``df`` is
    read more than once: pass a written table.
    """
    counts = materialise(running_counts(df, keys, value), "counts")
    placed = attach(df, counts, [*keys, value])
    total = F.col("n_total")
    share = F.when(total == 1, F.lit(0.0)).otherwise(F.col("n_below") / (total - 1))
    return placed.select(*df.columns, share.alias(out))


def with_position(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos"
) -> DataFrame:
    """Adds the 1-based position by ``order`` within ``keys``, NULL first and NaN last.

    A random number ends the order, so rows that are equal in all of it are spread as well.
    """
    numbered = df.withColumns({"__one": F.lit(1).cast("long"), "__last": F.rand(7)})
    placed = running_sums(numbered, keys, [*order, "__last"], ["__one"])
    return placed.select(*df.columns, F.col("__one_upto").alias(out))


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row with the exact median of each numeric column, NULLs left out."""
    cells = [
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols
    ]
    long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.name", "cell.value")
    stats = running_counts(long.filter(F.col("value").isNotNull()), ["name"], "value")
    low = F.floor((F.col("n_total") - 1) / 2)
    high = F.floor(F.col("n_total") / 2)

    def at(pos: Column) -> Column:
        here = (F.col("n_below") <= pos) & (pos < F.col("n_below") + F.col("n"))
        return F.max(F.when(here, F.col("value")))

    middles = stats.groupBy("name").agg(((at(low) + at(high)) / 2).alias("median"))
    return middles.agg(
        *[F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in cols]
    )


def count_below(
    points: DataFrame, rows: DataFrame, keys: list[str], value: str
) -> DataFrame:
    """For each distinct (keys, value) of ``points``: the number of ``rows`` below and at it.

    Points enter the running count with weight 0, so no point meets a row in a join.
    """
    both = (
        rows.select(*keys, value)
        .withColumns({"__n": F.lit(1), "__p": F.lit(0)})
        .unionByName(
            points.select(*keys, value).withColumns({"__n": F.lit(0), "__p": F.lit(1)})
        )
    )
    weights = {"n": F.col("__n"), "p": F.col("__p")}
    stats = running_counts(both, keys, value, weights)
    return stats.filter(F.col("p") > 0).select(
        *keys,
        value,
        F.col("n_below").alias("below"),
        (F.col("n_below") + F.col("n")).alias("upto"),
        F.col("n_total").alias("total"),
    )
