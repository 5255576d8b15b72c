"""Evaluation of predictions, each from one pass or one exact rank sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.operators.ordered import running_counts

# Fixed values.
RANK_TOLERANCES = [500, 1000, 2000]
SHARE_TOLERANCES = [10, 20]


def regression_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """RMSE, MAE, R², and the percentage of rows within rank and relative limits."""
    y, p = F.col(truth), F.col(prediction)
    error = F.abs(y - p)
    relative = error / F.greatest(y, F.lit(1.0))
    squares = F.sum((y - p) * (y - p))

    def percent(cond):
        return F.avg(F.when(cond, 100.0).otherwise(0.0))

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(error).alias("mae"),
        (1 - squares / (F.var_pop(y) * F.count(y))).alias("r2"),
        *[percent(error <= t).alias(f"within_{t}") for t in RANK_TOLERANCES],
        *[percent(relative <= t / 100).alias(f"within_{t}_pct") for t in SHARE_TOLERANCES],
    )


def exact_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half."""
    sides = {
        "pos": F.when(F.col(label) == 1, 1).otherwise(0),
        "neg": F.when(F.col(label) == 0, 1).otherwise(0),
    }
    known = df.filter(F.col(score).isNotNull())
    stats = running_counts(known, [], score, sides)
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)
    pairs = F.max("pos_total").cast("double") * F.max("neg_total")
    return stats.agg(
        (F.sum(won) / F.nullif(pairs, F.lit(0.0))).alias("auc"),
        F.max("pos_total").alias("n_positive"),
        F.max("neg_total").alias("n_negative"),
    )


def classification_report(
    df: DataFrame, label: str, score: str, threshold: float = 0.5
) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    truth, guess = F.col(label) == 1, F.col(score) >= threshold
    cells = df.agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    def side(name: int, hit: str, wrong: str, missed: str):
        return F.struct(
            F.lit(name).alias("class"),
            F.col(hit).alias("hit"),
            F.col(wrong).alias("wrong"),
            F.col(missed).alias("missed"),
        )

    both = F.array(side(0, "tn", "fn", "fp"), side(1, "tp", "fp", "fn"))
    rows = cells.select(F.explode(both).alias("c")).select("c.*")

    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    return rows.select(
        "class",
        ratio(hit, hit + wrong).alias("precision"),
        ratio(hit, hit + missed).alias("recall"),
        ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
        (hit + missed).alias("support"),
    )
