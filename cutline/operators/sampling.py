"""Deterministic samples, splits, folds and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.functions.hashing import stable_digest, stable_hash
from cutline.operators.ordered import attach, match_null_safe, with_position
from cutline.session import materialise

# Fixed value: ranks of negative samples end below this.
RANK_LIMIT = 500_001


def sample_eligibility(
    features: DataFrame,
    keys: list[str],
    neg_ratio: float = 1.5,
    rank_limit: int = RANK_LIMIT,
    seed: int = 42,
) -> DataFrame:
    """One eligible and ``max(1, int(neg_ratio))`` ineligible ranks per feature row.

    Eligible ranks are uniform on [max(1, opening), closing], the others on
    [closing + 1, max(rank_limit, closing + 2)) . Rows with no eligible rank are left out.
    """
    negatives = max(1, int(neg_ratio))
    low = F.greatest(F.lit(1), F.col("opening_rank_min").cast("long"))
    high = F.col("closing_rank_max").cast("long")
    draws = F.explode(F.sequence(F.lit(0), F.lit(negatives)))
    rows = (
        features.withColumns({"__low": low, "__high": high})
        .filter(F.col("__low") <= F.col("__high"))
        .withColumn("draw", draws)
    )
    chance = stable_hash(*keys, F.col("draw"), seed=seed)
    eligible = F.col("draw") == 0
    first = F.when(eligible, F.col("__low")).otherwise(F.col("__high") + 1)
    beyond = F.when(eligible, F.col("__high") + 1).otherwise(
        F.greatest(F.lit(rank_limit), F.col("__high") + 2)
    )
    return rows.withColumns(
        {
            "student_rank": first + F.pmod(chance, beyond - first),
            "eligible": eligible.cast("int"),
        }
    ).drop("__low", "__high")


def split_by_hash(
    df: DataFrame, keys: list[str], test_percent: int = 15, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``; about ``test_percent`` of the rows, no shuffle."""
    share = F.pmod(stable_hash(*keys, seed=seed), F.lit(100))
    return df.withColumn("is_test", (share < test_percent).cast("int"))


DIGITS = 3  # hexadecimal digits of the digest that a round looks at: 4,096 buckets per label
CUT_ROWS = 10_000  # rows of a bucket that need no further round


def _cut_digests(
    hashed: DataFrame, label: str, test_percent: int
) -> DataFrame:
    """Radix selection: the digest at which each label's test part ends.

    Columns: label, ``__cut``, ``__n`` (rows of the label) and ``__take`` (how many rows with exactly
    that digest are in the test part). A round counts the digests' next digits, which combine on
    the map side, and keeps the one bucket per label in which the cut falls; when no bucket holds
    more than ``CUT_ROWS`` rows, or the digits are used up, the cut is picked from it.
    """
    state, rows, depth = None, hashed, 0
    while True:
        depth += DIGITS
        bucket = F.substring("__digest", 1, depth).alias("__prefix")
        counts = rows.groupBy(label, bucket).agg(F.count(F.lit(1)).alias("__size"))
        group = Window.partitionBy(label)
        before = group.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("__below", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        if state is None:
            whole = F.sum("__size").over(group)
            counts = counts.withColumns(
                {"__n": whole, "__need": F.ceil(whole * test_percent / 100).cast("long")}
            )
        else:
            counts = match_null_safe(counts, state.select(label, "__n", "__need"), [label])
        hit = (F.col("__below") < F.col("__need")) & (
            F.col("__need") <= F.col("__below") + F.col("__size")
        )
        state = materialise(
            counts.filter(hit).select(
                label, "__prefix", "__size", "__n", (F.col("__need") - F.col("__below")).alias("__need")
            ),
            "cut",
        )
        inside = F.substring("__digest", 1, depth) == F.col("__prefix")
        cut = attach(hashed, state.select(label, "__prefix", "__n"), [label], "__n").filter(inside)
        # Only the rows of one bucket per label go on.
        rows = materialise(cut.select(label, "__digest"), "bucket")
        if depth >= 32 or not state.filter(F.col("__size") > CUT_ROWS).take(1):
            break
    sizes = rows.groupBy(label, "__digest").agg(F.count(F.lit(1)).alias("__size"))
    upto = Window.partitionBy(label).orderBy("__digest")
    placed = sizes.withColumn("__upto", F.sum("__size").over(upto))
    last = match_null_safe(placed, state.select(label, "__n", "__need"), [label])
    below = F.col("__upto") - F.col("__size")
    last = last.filter((below < F.col("__need")) & (F.col("__need") <= F.col("__upto")))
    return materialise(
        last.select(
            label, F.col("__digest").alias("__cut"), "__n",
            (F.col("__need") - below).alias("__take"), "__size",
        ),
        "cuts",
    )


def split_stratified(
    df: DataFrame, label: str, keys: list[str], test_percent: int = 15, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: exactly the rounded-up share of each label value, by digest order.

    There may be any number of label values, NULL is one, and one may hold most rows. The digest at
    which a label's test part ends is selected without sorting; then each row is decided where it
    is. Only copies of a key that sits exactly at the cut are numbered, as they cannot be told
    apart otherwise. ``df`` is read more than once: pass a written table.
    """
    hashed = df.withColumn("__digest", stable_digest(*keys, seed=seed))
    cuts = _cut_digests(hashed, label, test_percent)
    placed = attach(hashed, cuts, [label], "__n")
    split = F.col("__size") > F.col("__take")
    at_cut = F.coalesce((F.col("__digest") == F.col("__cut")) & split, F.lit(False))
    clear = placed.filter(~at_cut).withColumn(
        "is_test", F.coalesce((F.col("__digest") <= F.col("__cut")).cast("int"), F.lit(0))
    ).select(*df.columns, "is_test")
    if not cuts.filter(split).take(1):
        return clear
    copies = with_position(materialise(placed.filter(at_cut), "copies"), [label], ["__digest"], "__at")
    edge = copies.withColumn("is_test", (F.col("__at") <= F.col("__take")).cast("int"))
    return clear.unionByName(edge.select(*df.columns, "is_test"))


def assign_folds(df: DataFrame, keys: list[str], folds: int = 3, seed: int = 42) -> DataFrame:
    fold = F.pmod(stable_hash(*keys, seed=seed), F.lit(folds)).cast("int")
    return df.withColumn("fold", fold)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(label).cast("long").alias("n_positive"),
        F.sum(1 - F.col(label)).cast("long").alias("n_negative"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Largest class count over the class's count, one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    every_class = Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.max("n_rows").over(every_class) / F.col("n_rows"))


def with_class_weight(
    df: DataFrame, label: str, out: str = "weight", counted: DataFrame | None = None
) -> DataFrame:
    """Adds the balanced weight of a 0/1 label, from one pass over the labels (of ``counted``)."""
    ones = F.count_if(F.col(label) == 1)
    zeros = F.count_if(F.col(label) == 0)
    largest = F.greatest(ones, zeros)
    weights = (df if counted is None else counted).agg(
        F.struct(
            (largest / F.nullif(ones, F.lit(0))).alias("one"),
            (largest / F.nullif(zeros, F.lit(0))).alias("zero"),
        ).alias("w")
    ).scalar()
    return df.withColumn(
        out, F.when(F.col(label) == 1, weights["one"]).otherwise(weights["zero"])
    )
