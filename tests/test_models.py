"""Mean targets, the search, saved models and scoring by rank intervals."""

import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import encoding, models
from cutline.session import materialise
from tests.conftest import rows


def sample(spark, n=600, values=30):
    df = spark.range(n).select(
        F.concat(F.lit("c"), F.col("id") % values).alias("institute"),
        F.when(F.col("id") % 9 == 0, None).otherwise("GM").alias("category"),
        (2018 + F.col("id") % 4).cast("int").alias("year"),
        ((F.col("id") % values) * 100 + 500 + F.col("id") % 7).cast("double").alias("closing_rank"),
    )
    return materialise(df, "sample")


def test_means_leave_out_the_own_fold(spark):
    dice = random.Random(1)
    data = [(dice.choice("abc"), dice.choice("xy"), dice.randrange(3), dice.uniform(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(data, "a STRING, b STRING, fold INT, y DOUBLE")
    sums = encoding.fold_sums(df, ["a", "b"], "y")
    means = materialise(encoding.target_means(sums, [0, 1, 2], 4.0), "means")
    got = {(r.column, r.value, r.fold): r["mean"] for r in means.collect()}
    assert len(got) == (3 + 2 + 1) * 4
    for (col, value, fold), mean in got.items():
        out = [t for t in data if t[2] != fold]
        prior = sum(t[3] for t in out) / len(out)
        own = [t[3] for t in out if col and t["ab".index(col)] == value]
        assert mean == pytest.approx((sum(own) + 4 * prior) / (len(own) + 4) if col else prior)
    joined = encoding.with_means(df.withColumn("a", F.when(F.col("fold") == 1, "new").otherwise(F.col("a"))), means, ["a"], "fold")
    for r in joined.collect():
        assert r.a__mean == pytest.approx(got["a" if r.a != "new" else "", r.a if r.a != "new" else "", r.fold])
    new = encoding.with_means(df.limit(2).withColumn("a", F.lit("new")), means, ["a"])
    assert {r.a__mean for r in new.collect()} == {got["", "", -1]}
    assert encoding.with_means(df.withColumn("a", F.lit("new")), means, ["a"], unseen="drop").count() == 0


def test_one_fold_and_no_rows(spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 4.0)], "a STRING, fold INT, y DOUBLE")
    means = encoding.target_means(encoding.fold_sums(df, ["a"], "y"), [0, 1])
    assert all(r["mean"] == pytest.approx(3.0, abs=0.5) for r in means.collect())
    assert encoding.target_means(encoding.fold_sums(df.limit(0), ["a"], "y"), [0]).count() == 0


def test_plan_has_no_gathered_vocabulary(spark):
    """Encoding is the same plan for few and many values."""
    small, large = (sample(spark, 400, v) for v in (3, 390))
    for df in (small, large):
        model = models.train_regressor(df, models.NEET_SPEC, maxIter=2, maxDepth=2)
        assert {type(s).__name__ for s in model.trees.stages} == {"VectorAssembler", "GBTRegressionModel"}
    assert models.score_ranks(model, large).count() == 400


def test_saved_model_scores_alike(spark, tmp_path):
    df = sample(spark)
    df = df.withColumn("year", F.when(F.col("year") != 2019, F.col("year")))
    model = models.train_regressor(df, models.NEET_SPEC, maxIter=5, maxDepth=3)
    assert model.spec.fills == {"year": 2020.0}  # the median of the years known
    models.save_artifacts(str(tmp_path / "m"), model)
    loaded, history = models.load_artifacts(spark, str(tmp_path / "m"))
    assert loaded.spec == model.spec and history is None
    names = ["institute", "category", "year", "closing_rank", "pred_closing_rank"]
    assert rows(models.score_ranks(loaded, df), *names) == rows(models.score_ranks(model, df), *names)
    filled = models.score_ranks(loaded, df.withColumn("year", F.lit(None).cast("int"))).collect()
    at = models.score_ranks(loaded, df.withColumn("year", F.lit(2020))).collect()
    assert [r.pred_closing_rank for r in filled] == [r.pred_closing_rank for r in at]


def test_held_out_rows_do_not_shape_the_model(spark):
    """Other labels of the held-out rows leave fills, mean targets and weights as they were."""
    df = sample(spark).withColumns(
        {"eligible": (F.col("closing_rank") > 2000).cast("int"), "held_out": F.col("year") == 2021}
    )
    other = df.withColumn("eligible", F.when(F.col("held_out"), 1).otherwise(F.col("eligible")))
    made = [
        models.train_classifier(materialise(d), models.NEET_SPEC, "held_out", maxIter=2, maxDepth=2)
        for d in (df, other)
    ]
    assert made[0].spec == made[1].spec
    whole = "fold = -1"  # the folds are dealt anew
    means = [rows(m.means.filter(whole).select("column", "value", F.round("mean", 9))) for m in made]
    assert means[0] == means[1]


def test_search_learns_and_stays_in_range():
    ranges = {"maxIter": (10, 400), "stepSize": (0.01, 0.3)}

    def loss(one):
        return abs(one["maxIter"] - 300) / 400 + abs(one["stepSize"] - 0.05)

    learned, plain = [], []
    for seed in range(60):
        dice, done = random.Random(seed), []
        for _ in range(40):
            one = models.propose(dice, ranges, done)
            assert isinstance(one["maxIter"], int) and 10 <= one["maxIter"] <= 400
            assert 0.01 <= one["stepSize"] <= 0.3
            done.append((one, loss(one)))
        learned.append(min(x for _, x in done))
        plain.append(min(loss(s) for s in models.draw_settings(ranges, 40, seed)))
    # The best of 40 trials lies on average much nearer to the optimum than that of random ones.
    assert sum(learned) < 0.75 * sum(plain)


def test_trials_are_given_up_early(spark):
    ranges = {"maxIter": (3, 6), "maxDepth": (1, 4), "stepSize": (0.05, 0.5)}
    trials = models.tune_regressor(sample(spark, 300, 12), models.NEET_SPEC, ["institute", "year"], ranges, 6, folds=2)
    assert [t.number for t in trials] == list(range(6)) and trials[0].rmse is not None
    assert all((t.rmse is None) == (t.folds == 0) for t in trials)
    assert models.best_trial(trials).rmse <= trials[0].rmse
