"""Training and scoring with Spark ML.

Categories enter the trees as mean targets (:mod:`cutline.operators.encoding`), numbers with the
training rows' medians for NULL. Both are fitted on training rows only, saved with the trees, and
used for scoring as they were for training.
"""

from __future__ import annotations

import json
import math
import random
import re
import statistics
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.functions.ranks import log_rank, unlog_rank
from cutline.functions.text import vocab_text
from cutline.operators.encoding import fold_sums, target_means, with_means, with_random_fold
from cutline.operators.ordered import exact_medians
from cutline.operators.sampling import assign_folds, with_class_weight
from cutline.session import materialise

# Feature lists and search ranges.
JEE_NUMERIC = [
    "closing_rank_max", "opening_rank_min", "closing_rank_avg", "closing_rank_std",
    "rank_spread_avg", "rank_pressure", "difficulty_pct", "years_available",
    "yoy_rank_change", "student_rank",
]
JEE_CATEGORICAL = [
    "institute_short", "program_name", "degree_short", "category", "quota", "pool",
    "trend_direction",
]
NEET_CATEGORICAL = ["institute", "category"]
KCET_CATEGORICAL = [
    "college_name", "course_name", "category", "base_category", "quota", "region",
]
COMEDK_CATEGORICAL = ["college_name", "course_name", "category"]
COMEDK_NUMERIC = [
    "year", "prev_year_closing_rank", "closing_rank_mean", "closing_rank_std",
    "closing_rank_min", "closing_rank_max", "rank_trend", "years_available",
    "latest_year", "earliest_year", "college_avg_rank", "category_avg_rank",
]
JEE_SETTINGS = {"maxIter": 800, "maxDepth": 7, "stepSize": 0.05}
SEARCH = {
    "kcet": {"maxIter": (100, 400), "maxDepth": (4, 10), "stepSize": (0.01, 0.15)},
    "neet": {"maxIter": (50, 300), "maxDepth": (4, 10), "stepSize": (0.01, 0.15)},
    "comedk": {
        "maxIter": (300, 800), "maxDepth": (4, 8), "stepSize": (0.01, 0.2),
        "minInstancesPerNode": (1, 10),
    },
}
TRIALS = {"kcet": (15, 3), "neet": (30, 3), "comedk": (30, 5)}

SEED = 42
BINS = 64  # ranges of a feature's values that a tree may split at
FOLDS = 5  # of the mean targets


@dataclass(frozen=True)
class FeatureSpec:
    """Columns of a model, and the number that stands for NULL in each numeric one (else 0)."""

    categorical: list[str]
    numeric: list[str]
    fills: dict[str, float] = field(default_factory=dict)

    def inputs(self) -> list[str]:
        return [*[f"{c}__mean" for c in self.categorical], *self.numeric]


JEE_SPEC = FeatureSpec(JEE_CATEGORICAL, JEE_NUMERIC)
NEET_SPEC = FeatureSpec(NEET_CATEGORICAL, ["year"])
KCET_SPEC = FeatureSpec(KCET_CATEGORICAL, ["year"])
COMEDK_SPEC = FeatureSpec(COMEDK_CATEGORICAL, COMEDK_NUMERIC)


@dataclass(frozen=True)
class FittedModel:
    """Trees with everything that scoring needs: columns, fills and mean targets."""

    trees: PipelineModel
    means: DataFrame
    spec: FeatureSpec
    unseen: str = "prior"


def with_fills(rows: DataFrame, spec: FeatureSpec) -> FeatureSpec:
    """``spec`` with the exact medians of ``rows`` (a written table) where it names no fill."""
    wanted = [c for c in spec.numeric if c not in spec.fills and c in rows.columns]
    if not wanted:
        return spec
    found = exact_medians(rows, wanted).first().asDict()
    medians = {c: float(v) for c, v in found.items() if v is not None}
    return replace(spec, fills={**medians, **spec.fills})


def prepare(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Numbers as double with NULL filled, categories never NULL."""
    numbers = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(spec.fills.get(c, 0.0))))
        for c in spec.numeric
    }
    texts = {c: F.coalesce(vocab_text(c), F.lit("UNKNOWN")) for c in spec.categorical}
    return df.withColumns({**numbers, **texts})


def with_log_label(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target) > 0).withColumn("label", log_rank(target))


def _assembler(spec: FeatureSpec) -> VectorAssembler:
    return VectorAssembler(inputCols=spec.inputs(), outputCol="features")


def _encoded(rows: DataFrame, spec: FeatureSpec, held: str | None = None):
    """Training rows with out-of-fold means, those marked ``held`` with the means of all training
    rows; and the table of means. ``rows`` are prepared and labelled."""
    dealt = materialise(with_random_fold(rows, FOLDS, SEED), "train")
    train = dealt if held is None else dealt.filter(~F.col(held))
    folds = list(range(FOLDS))
    sums = materialise(fold_sums(train, spec.categorical, "label"), "sums")
    means = materialise(target_means(sums, folds), "means")
    if held is not None:
        dealt = dealt.withColumn("fold", F.when(F.col(held), -1).otherwise(F.col("fold")))
    return with_means(dealt, means, spec.categorical, "fold"), means


def train_regressor(
    train: DataFrame, spec: FeatureSpec, target: str = "closing_rank", **settings
) -> FittedModel:
    """Boosted trees on the log of the closing rank. ``train`` is a written table."""
    spec = with_fills(train, spec)
    encoded, means = _encoded(with_log_label(prepare(train, spec), target), spec)
    assembler = _assembler(spec)
    options = {"maxBins": BINS, "seed": SEED, **settings}
    trees = GBTRegressor(featuresCol="features", labelCol="label", **options)
    fitted = trees.fit(materialise(assembler.transform(encoded).select("features", "label"), "fit"))
    return FittedModel(PipelineModel(stages=[assembler, fitted]), means, spec)


def train_classifier(
    samples: DataFrame, spec: FeatureSpec = JEE_SPEC, validation: str | None = None, **settings
) -> FittedModel:
    """Boosted trees on eligibility with balanced class weights.

    ``validation`` names a boolean column whose rows stop the boosting early; fills, mean targets and
    weights do not see them. ``samples`` is a written table.
    """
    options = {**JEE_SETTINGS, "maxBins": BINS, "seed": SEED, **settings}
    train = samples if validation is None else samples.filter(~F.col(validation))
    spec = with_fills(train, spec)
    label = F.col("eligible").cast("double")
    encoded, means = _encoded(prepare(samples, spec).withColumn("label", label), spec, validation)
    seen = train.select(label.alias("label"))
    weighted = with_class_weight(encoded, "label", counted=seen)
    columns = ["features", "label", "weight"]
    if validation is not None:
        options["validationIndicatorCol"] = validation
        columns.append(validation)
    assembler = _assembler(spec)
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **options)
    fitted = trees.fit(materialise(assembler.transform(weighted).select(*columns), "fit"))
    return FittedModel(PipelineModel(stages=[assembler, fitted]), means, spec)


def _scored(model: FittedModel, df: DataFrame) -> DataFrame:
    copy = prepare(df.withColumn("__raw", F.struct(*df.columns)), model.spec)
    needed = copy.select("__raw", *model.spec.categorical, *model.spec.numeric)
    encoded = with_means(needed, model.means, model.spec.categorical, unseen=model.unseen)
    return model.trees.transform(encoded)


def score_ranks(model: FittedModel, df: DataFrame) -> DataFrame:
    """Adds ``pred_closing_rank``; the original columns stay as they were."""
    return _scored(model, df).select(
        *[F.col(f"__raw.{c}").alias(c) for c in df.columns],
        unlog_rank("prediction").alias("pred_closing_rank"),
    )


def score_eligibility(model: FittedModel, df: DataFrame) -> DataFrame:
    """Adds ``eligibility_prob`` rounded to 4 places."""
    return _scored(model, df).select(
        *[F.col(f"__raw.{c}").alias(c) for c in df.columns],
        F.round(vector_to_array("probability")[1], 4).alias("eligibility_prob"),
    )


def dropping_unseen(model: FittedModel) -> FittedModel:
    """The same model, but rows with a category value it never saw leave the result."""
    return replace(model, unseen="drop")


def split_points(model: FittedModel, column: str) -> list[float]:
    """Rising thresholds at which the trees split a numeric column: between two neighbours the
    score does not depend on it. There are fewer than ``BINS``, whatever the number of trees."""
    at = model.spec.inputs().index(column)
    trees = model.trees.stages[-1]
    return sorted({float(x) for x in re.findall(rf"feature {at} <= (\S+?)\)", trees.toDebugString)})


def feature_importance(spark: SparkSession, model: FittedModel, limit: int = 10) -> DataFrame:
    """Most important inputs of the model's trees (as many rows as the model has inputs)."""
    weights = model.trees.stages[-1].featureImportances.toArray()
    rows = [(c, float(w)) for c, w in zip(model.spec.inputs(), weights)]
    table = spark.createDataFrame(rows, "feature STRING, importance DOUBLE")
    return table.orderBy(F.col("importance").desc(), "feature").limit(limit)


# ---- search ------------------------------------------------------------------------

STARTUP = 5  # random trials before the sampler learns from them
GOOD_SHARE = 0.25  # best trials that the sampler imitates
CANDIDATES = 24
RUNG = 3  # the first look at a trial has one in so many of its trees


def _to_line(name: str, value: float, low) -> float:
    return float(value) if isinstance(low, int) else math.log(value)


def _draw(dice: random.Random, ranges: dict) -> dict:
    """Uniform settings: whole numbers as they are, others in their logarithm."""
    one = {}
    for name, (low, high) in ranges.items():
        if isinstance(low, int):
            one[name] = dice.randint(low, high)
        else:
            one[name] = math.exp(dice.uniform(math.log(low), math.log(high)))
    return one


def draw_settings(ranges: dict, trials: int, seed: int = SEED) -> list[dict]:
    """Random settings."""
    dice = random.Random(seed)
    return [_draw(dice, ranges) for _ in range(trials)]


def propose(dice: random.Random, ranges: dict, done: list[tuple[dict, float]]) -> dict:
    """Next settings, from the settings and losses of past trials (a Parzen estimator).

    The best trials and the others each make a mixture of normal distributions around their
    settings, and a wide one over the whole range. Of candidates drawn from the first mixture the one
    that is likeliest under it, relative to the second, is tried next.
    """
    if len(done) < STARTUP:
        return _draw(dice, ranges)
    ranked = [one for one, _ in sorted(done, key=lambda t: t[1])]
    cut = max(1, math.ceil(GOOD_SHARE * len(ranked)))
    good, rest = ranked[:cut], ranked[cut:]
    one = {}
    for name, (low, high) in ranges.items():
        a, b = _to_line(name, low, low), _to_line(name, high, low)
        width = max(b - a, 1e-12)

        def density(x: float, group: list[dict]) -> float:
            points = [_to_line(name, g[name], low) for g in group]
            spread = width / (1 + len(points))
            bells = sum(math.exp(-0.5 * ((x - p) / spread) ** 2) / spread for p in points)
            return (bells / 2.5066 + 1 / width) / (1 + len(points))

        spread = width / (1 + len(good))
        points = [_to_line(name, g[name], low) for g in good]
        drawn = [
            dice.uniform(a, b) if dice.random() < 1 / (1 + len(points))
            else min(b, max(a, dice.gauss(dice.choice(points), spread)))
            for _ in range(CANDIDATES)
        ]
        best = max(drawn, key=lambda x: density(x, good) / density(x, rest))
        one[name] = round(best) if isinstance(low, int) else min(high, max(low, math.exp(best)))
    return one


@dataclass(frozen=True)
class Trial:
    """Settings, how many folds were fitted with them, and the mean RMSE (None if given up)."""

    number: int
    settings: dict
    folds: int
    rmse: float | None
    first_look: float


def tune_regressor(
    train: DataFrame,
    spec: FeatureSpec,
    keys: list[str],
    ranges: dict,
    trials: int,
    folds: int = 3,
    target: str = "closing_rank",
    in_ranks: bool = False,
    seed: int = SEED,
) -> list[Trial]:
    """Sequential search over ``ranges`` by cross-validation on hash folds of ``keys``.

    For every fold the rows are encoded once, with mean targets of the other folds only. A trial is first
    fitted with a third of its trees on one fold and given up there if it is worse than the median of
    the trials before it; the others are fitted on all folds, each of which also stops its own
    boosting early. Pass a written table.
    """
    spec = with_fills(train, spec)
    rows = with_log_label(prepare(train, spec), target)
    dealt = assign_folds(rows, keys, folds).withColumnRenamed("fold", "cv_fold")
    dealt = dealt.select(*spec.categorical, *spec.numeric, "label", "cv_fold")
    dealt = materialise(dealt, "tune")
    parts = []
    for held in range(folds):
        marked = dealt.withColumn("held_out", F.col("cv_fold") == held)
        encoded, _ = _encoded(marked, spec, "held_out")
        encoded = _assembler(spec).transform(encoded).select("features", "label", "held_out")
        parts.append(materialise(encoded, "fold"))

    def loss(settings: dict, part: DataFrame) -> float:
        trees = GBTRegressor(
            featuresCol="features", labelCol="label", maxBins=BINS, seed=SEED,
            validationIndicatorCol="held_out", **settings,
        )
        scored = trees.fit(part).transform(part.filter("held_out"))
        gap = F.col("label") - F.col("prediction")
        if in_ranks:
            gap = F.expm1("label") - F.expm1("prediction")
        return scored.agg(F.sqrt(F.avg(gap * gap)).alias("rmse")).first()["rmse"]

    dice = random.Random(seed)
    made: list[Trial] = []
    for number in range(trials):
        # A trial that was given up counts with its first look, which is no better than its end.
        past = [(t.settings, t.rmse if t.rmse is not None else t.first_look) for t in made]
        one = propose(dice, ranges, past)
        short = {**one, "maxIter": max(1, one["maxIter"] // RUNG)} if "maxIter" in one else one
        look = loss(short, parts[0])
        if made and look > statistics.median(t.first_look for t in made):
            made.append(Trial(number, one, 0, None, look))
            continue
        scores = [loss(one, part) for part in parts]
        made.append(Trial(number, one, folds, statistics.fmean(scores), look))
    return made


def best_trial(trials: list[Trial]) -> Trial:
    return min((t for t in trials if t.rmse is not None), key=lambda t: t.rmse)


# ---- artifacts ---------------------------------------------------------------------


def save_artifacts(path: str, model: FittedModel, history: DataFrame | None = None) -> None:
    """One folder: trees, mean targets, columns and fills, and the history if there is one."""
    spark = model.means.sparkSession
    model.trees.write().overwrite().save(f"{path}/model")
    model.means.write.mode("overwrite").parquet(f"{path}/means")
    spec = spark.createDataFrame([(json.dumps(asdict(model.spec)),)], "spec STRING")
    spec.write.mode("overwrite").parquet(f"{path}/spec")
    if history is not None:
        history.write.mode("overwrite").parquet(f"{path}/history")


def load_artifacts(spark: SparkSession, path: str) -> tuple[FittedModel, DataFrame | None]:
    spec = FeatureSpec(**json.loads(spark.read.parquet(f"{path}/spec").first()["spec"]))
    means = spark.read.parquet(f"{path}/means")
    model = FittedModel(PipelineModel.load(f"{path}/model"), means, spec)
    try:
        return model, spark.read.parquet(f"{path}/history")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return model, None
